"""Small keyed tables as snapshot folders: the manifest of files and the cache of chunks; tables in buckets for larger ones."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.merge import replace_by_key

#: Versions of a table that stay readable; older ones are removed.
VERSIONS = 3


class SnapshotFolder:
    """A table of which there is one whole version at any time.

    A write makes a new data folder and then a pointer file of the next number, which no other writer can take. Readers go by
    the highest pointer that is whole and whose data is: they see the old version or the new one, never a part or none. A write cut
    off anywhere leaves the version before it. The last ``VERSIONS`` versions stay, for readers under way.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema

    def _hadoop(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _numbers(self) -> list[int]:
        """The pointers' numbers, highest first."""
        fs, path = self._hadoop()
        if not fs.exists(path(self.folder)):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(path(self.folder))]
        return sorted((int(n[8:-5]) for n in names if n.startswith("version-") and n.endswith(".json")), reverse=True)

    def _pointer(self, number: int) -> dict | None:
        """What a pointer says; None for one that isn't whole or whose data isn't there."""
        fs, path = self._hadoop()
        try:
            stream = fs.open(path(f"{self.folder}/version-{number:012d}.json"))
            try:
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            said = json.loads(text)
        except Exception:  # cut off while it was written, or removed meanwhile
            return None
        whole = all(fs.exists(path(f"{self.folder}/{name}")) for name in self._data(said))
        return said if whole else None

    @staticmethod
    def _data(said: dict) -> list[str]:
        return [said["folder"]]

    def info(self) -> dict | None:
        """What the latest whole pointer says; None before the first write."""
        for number in self._numbers():
            if (said := self._pointer(number)) is not None:
                return said
        return None

    def rows(self) -> DataFrame:
        now = self.info()
        if now is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/{now['folder']}")

    def replace(self, df: DataFrame, **info) -> None:
        name = f"rows-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{name}")
        self._publish(info | {"folder": name})

    def _publish(self, said: dict) -> None:
        fs, path = self._hadoop()
        numbers = self._numbers()
        number = (numbers[0] if numbers else 0) + 1
        out = fs.create(path(f"{self.folder}/version-{number:012d}.json"), False)  # an error where another writer took the number
        out.write(bytearray(json.dumps(said).encode()))
        out.close()
        self._prune()

    def _prune(self) -> None:
        """Removes versions no reader is at any more, and the data only they have."""
        fs, path = self._hadoop()
        whole = [(n, said) for n in self._numbers() if (said := self._pointer(n)) is not None]
        kept = {name for _, said in whole[:VERSIONS] for name in self._data(said)}
        for number, said in whole[VERSIONS:]:
            fs.delete(path(f"{self.folder}/version-{number:012d}.json"), False)
            for name in set(self._data(said)) - kept:
                fs.delete(path(f"{self.folder}/{name}"), True)


class BucketedFolder(SnapshotFolder):
    """A table by key in buckets of the key's hash: a write makes anew only the buckets it touches, and the pointer names each bucket's folder."""

    BUCKETS = 64

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str):
        super().__init__(spark, folder, schema)
        self.key = key

    @staticmethod
    def _data(said: dict) -> list[str]:
        return list(said["folders"].values())

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.BUCKETS)).cast("int")

    def buckets_of(self, df: DataFrame) -> list[int]:
        """The buckets the keys of some rows lie in; no more than there are buckets come to the driver."""
        return sorted(r[0] for r in df.select(self._bucket()).distinct().collect())

    def rows(self, buckets: Sequence[int] | None = None) -> DataFrame:
        now = self.info() or {"folders": {}}
        names = [f for b, f in now["folders"].items() if buckets is None or int(b) in buckets]
        if not names:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/{n}" for n in names])

    def write(self, df: DataFrame, buckets: Sequence[int] | None = None, **info) -> None:
        """``df`` in place of the buckets named, all of them if none are."""
        now = self.info() or {"folders": {}}
        kept = {} if buckets is None else {b: f for b, f in now["folders"].items() if int(b) not in buckets}
        name = f"rows-{uuid.uuid4().hex}"
        df.withColumn("__bucket", self._bucket()).repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.folder}/{name}")
        fs, path = self._hadoop()
        made = [f.getPath().getName() for f in fs.listStatus(path(f"{self.folder}/{name}")) if f.isDirectory()]
        kept |= {n.removeprefix("__bucket="): f"{name}/{n}" for n in made if n.startswith("__bucket=")}
        self._publish({k: v for k, v in now.items() if k != "folders"} | info | {"folders": kept})


class KeyedStore(SnapshotFolder):
    """A table by key."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: Sequence[str]):
        super().__init__(spark, folder, schema)
        self.keys = list(keys)

    def upsert(self, df: DataFrame) -> None:
        """Rows by key; of rows repeated under a key the one whose values come last counts."""
        rows = self.rows()
        rest = [c for c in rows.columns if c not in self.keys]
        fresh = df.groupBy(*self.keys).agg(F.max(F.struct(*rest)).alias("r")).select(*self.keys, "r.*").select(*rows.columns)
        self.replace(replace_by_key(rows, fresh, self.keys))

    def get(self, **key) -> DataFrame:
        found = self.rows()
        for k, v in key.items():
            found = found.where(F.col(k) == v)
        return found

    def delete(self, where: Column) -> int:
        """Rows a condition fits; how many there were."""
        rows = self.rows()
        n = rows.where(where).count()
        if n:
            self.replace(rows.where(~F.coalesce(where, F.lit(False))))
        return n


def manifest(spark: SparkSession, folder: str) -> KeyedStore:
    """``path`` to ``document_hash``."""
    return KeyedStore(spark, folder, "path string, document_hash string", ["path"])


def chunk_cache(spark: SparkSession, folder: str) -> KeyedStore:
    """``strategy, document_hash`` to chunks as JSON."""
    return KeyedStore(spark, folder, "strategy string, document_hash string, chunks string", ["strategy", "document_hash"])


def delete_hashes(cache: KeyedStore, hashes: Sequence[str]) -> int:
    """The cached chunks of documents, each hash once."""
    return cache.delete(F.col("document_hash").isin(list(dict.fromkeys(hashes)))) if hashes else 0


def forget(cache: KeyedStore, entries: DataFrame) -> int:
    """Removes the cached chunks of a manifest's entries, however many; how many there were."""
    kept = cache.rows()
    left = kept.join(entries.select("document_hash").distinct(), "document_hash", "left_anti").select(*kept.columns)
    before, after = kept.count(), left.count()
    if after < before:
        cache.replace(left)
    return before - after


def path_variants(folder: str, base: str | None = None) -> list[str]:
    """The forms in which a folder may stand in a manifest: as typed, without and with a closing slash, and both relative to the base."""
    forms = [folder, folder.rstrip("/"), folder.rstrip("/") + "/"]
    if base is not None and (folder.rstrip("/") + "/").startswith(base.rstrip("/") + "/"):
        below = folder.rstrip("/")[len(base.rstrip("/")) + 1 :]
        forms += [below, below + "/"] if below else []
    return [f for f in dict.fromkeys(forms) if f]


def reset(files: KeyedStore, cache: KeyedStore, folder: str, *, base: str | None = None, truncate: Callable[[], bool] | None = None) -> tuple[int, int, bool]:
    """Forgets the files below a folder and their chunks, and empties a collection: how many of each, and whether points went.

    Of the folder's forms the first that any file begins with is taken. A folder no file lies below removes nothing.
    """
    if not folder:
        raise ValueError("a reset needs a folder")
    emptied = truncate() if truncate is not None else False
    held = files.rows()
    for form in path_variants(folder, base):
        below = F.col("path").startswith(form)
        gone = held.where(below)
        if gone.isEmpty():
            continue
        forgotten = forget(cache, gone)
        return files.delete(below), forgotten, emptied
    return 0, 0, emptied
