"""Free-typed values to the entries of a reference list.

The entries and their alias paths (short labels, acronyms, codes, reordered parts, forms without articles) are one
trie. A typed value becomes a Levenshtein automaton, run over the trie: bit ``i`` of its row ``j`` says
that the first ``i`` characters are read with ``j`` errors. All entries within a distance that depends on the value's length
come back (``Gazetteer.entries``). The closest one is meant. A value that is cut off may mean the only entry that begins with it; to be cut counts
as two edits, and settles a tie. Another tie names none.

What stands before and after names is read off the list itself: words that begin a tenth of the full labels, whole, shortened or mistyped, may stand before a name,
and a closing word that is near no word of the list isn't part of one.

Values are matched where they lie, in the scan; a task remembers the values it has seen, so a value that holds
a third of all rows costs one search a task and no shuffle. Reference lists are collected behind a check of their size; a longer list is
dealt to shards, and each different value meets every shard (``match_long_list``).

Defined cases
* A null value gives no row; an empty, blank or unmatched one gives -1.
* Case, accents, punctuation and ``&`` for ``et`` don't matter.
* Repeated rows give one row each in ``match_columns``; callers keep distinct ones.
* An empty reference list matches nothing; null labels of the list are skipped.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.session import spread

#: A reference list of so many entries is collected; a longer one is dealt to shards of about as many.
MAX_ENTRIES = 50_000
#: Values a task remembers. A forgotten one is searched again.
MEMO = 200_000
#: A value may be the beginning of an entry from this many characters on, which counts as so many edits.
CUT_LEAST, CUT_COST = 8, 2
#: Values of a block that meets a shard of a long list.
VALUE_BLOCK = 20_000
NONE = -1

_WORD = re.compile(r"[^\W_]+")
#: French articles and joining words.
STOP = frozenset("de du des d la le les l au aux a et en".split())
#: French forms of address and of delegation, which may stand before the head of a name.
ADDRESS = frozenset("m mme monsieur madame delegue deleguee aupres".split())


def plain(text: str) -> list[str]:
    """Words without case and accents; ``&`` reads as ``et``, single letters in a row as one word."""
    text = unicodedata.normalize("NFKD", text.replace("&", " et ")).casefold()
    text = "".join(c for c in text if not unicodedata.combining(c)).replace("œ", "oe")
    return _WORD.findall(text)


def joined_letters(words: list[str]) -> list[str]:
    """Runs of single letters as one word: an acronym typed with points or blanks."""
    out: list[str] = []
    run = ""
    for w in [*words, ""]:
        if len(w) == 1 and w.isalpha():
            run += w
            continue
        if run:
            out.append(run)
            run = ""
        if w:
            out.append(w)
    return out


def allowed(length: int) -> int:
    """The distance within which a value of this length may name an entry."""
    if length <= 4:
        return 0
    if length <= 7:
        return 1
    if length <= 12:
        return 2
    if length <= 18:
        return 3
    return length // 6


class Trie:
    """Alias strings with the entries they name."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, alias: str, entry: int) -> None:
        node = self.root
        for c in alias:
            node = node.setdefault(c, {})
        node.setdefault(None, set()).add(entry)

    def exact(self, word: str) -> set[int]:
        node = self.root
        for c in word:
            node = node.get(c)
            if node is None:
                return set()
        return node.get(None, set())

    def below(self, word: str, fits: Callable[[int], bool] | None = None) -> set[int]:
        """The entries that fit with an alias that begins with the word; no more than two are looked for."""
        node = self.root
        for c in word:
            node = node.get(c)
            if node is None:
                return set()
        found: set[int] = set()
        todo = [node]
        while todo and len(found) < 2:
            node = todo.pop()
            for c, child in node.items():
                if c is None:
                    found |= {e for e in child if fits is None or fits(e)}
                else:
                    todo.append(child)
        return found

    def within(self, word: str, k: int) -> dict[int, int]:
        """Every entry with an alias within ``k`` edits, and its least distance; two swapped letters are one edit."""
        if k == 0:
            return {e: 0 for e in self.exact(word)}
        n = len(word)
        goal, full = 1 << n, (1 << (n + 1)) - 1
        masks: dict[str, int] = {}
        for i, c in enumerate(word):
            masks[c] = masks.get(c, 0) | 1 << i
        found: dict[int, int] = {}
        todo = [(self.root, [(1 << (j + 1)) - 1 & full for j in range(k + 1)], [0] * (k + 1))]
        while todo:
            node, rows, swaps = todo.pop()
            for c, child in node.items():
                if c is None:
                    for j, row in enumerate(rows):
                        if row & goal:
                            for e in child:
                                if found.get(e, k + 1) > j:
                                    found[e] = j
                            break
                    continue
                m = masks.get(c, 0)
                ahead = m >> 1
                before = rows[0]
                new = (before & m) << 1
                out, swapped, swap = [new], [before & ahead], swaps[0]
                for row, later in zip(rows[1:], swaps[1:]):
                    new = ((row & m) << 1 | before | before << 1 | new << 1 | (swap & m) << 2) & full
                    out.append(new)
                    swapped.append(row & ahead)
                    before, swap = row, later
                if new:
                    todo.append((child, out, swapped))
        return found


def leading_words(labels: list[str | None], least: float = 0.1) -> frozenset[str]:
    """The words that labels of one kind begin with: what all labels of the same first word share, where they are two and a tenth of all at least."""
    groups: dict[str, list[list[str]]] = {}
    given = [w for label in labels if label and (w := plain(label))]
    for words in given:
        groups.setdefault(words[0], []).append(words)
    out: set[str] = set()
    for group in groups.values():
        if len(group) >= max(2, least * len(given)):
            for column in zip(*group):
                if len(set(column)) > 1 or column[0] in STOP and column[0] != "d":  # a joining word ends what stands before the name
                    break
                out.add(column[0])
    return frozenset(out - STOP)


class Gazetteer:
    """A reference list ready to be searched.

    ``heads`` are words that may stand before the name (titles, kinds of unit), typed with errors, shortened or not;
    they are taken off both sides.
    """

    def __init__(self, heads: frozenset[str] = frozenset()):
        self.trie = Trie()
        #: Labels with their heads, for values whose head is typed past recognition.
        self.whole = Trie()
        #: Every word of the labels.
        self.words = Trie()
        self.heads = heads
        self._head_trie = Trie()
        for h in heads | (ADDRESS if heads else frozenset()):
            self._head_trie.add(h, 0)
        self.is_head = lru_cache(MEMO)(self._is_head)
        self.foreign = lru_cache(MEMO)(self._foreign)

    def _is_head(self, word: str) -> bool:
        if not self.heads:
            return False
        if len(word) <= 4 and self._head_trie.below(word):  # whole or shortened
            return True
        return bool(self._head_trie.within(word, 0 if len(word) < 5 else 1 if len(word) < 6 else 2 if len(word) < 8 else 3))

    def _foreign(self, word: str) -> bool:
        """Whether a word is near no word of the list, nor the beginning of one."""
        return word not in STOP and not self.words.below(word) and not self.words.within(word, allowed(len(word)))

    def behead(self, words: list[str]) -> list[str]:
        i = last = 0
        while i < len(words):
            if self.is_head(words[i]):
                last = i + 1
            elif words[i] not in STOP:
                break
            i += 1
        rest = words[last:]
        while rest and rest[0] in STOP:
            rest = rest[1:]
        return rest

    def without_tail(self, words: list[str]) -> list[str]:
        """Without the closing words that are foreign to the list; joining words go with them."""
        end = len(words)
        while end and self.foreign(words[end - 1]):
            end -= 1
            while end and words[end - 1] in STOP:
                end -= 1
        return words[:end]

    def add(self, label: str | None, entry: int) -> None:
        """The label, its form without articles, and every order of its parts."""
        if not label:
            return
        words = self.behead(plain(label))
        if not words:
            return
        for w in words:
            self.words.add(w, entry)
        self.trie.add(" ".join(words), entry)
        self.trie.add(self.bare(words), entry)
        self.whole.add(" ".join(plain(label)), entry)
        parts = [[w for w in self.behead(plain(p)) if w not in STOP] for p in re.split(r",| et ", label)]
        parts = [p for p in parts if p]
        if 1 < len(parts) <= 4:
            for order in permutations(parts):
                self.trie.add(" ".join(w for p in order for w in p), entry)

    def add_word(self, alias: str | None, entry: int) -> None:
        """An alias taken as it stands, such as an acronym or a code."""
        if alias and (words := plain(alias)):
            self.trie.add(" ".join(words), entry)

    @staticmethod
    def bare(words: list[str]) -> str:
        return " ".join(w for w in words if w not in STOP)

    def entries(self, text: str, fits: Callable[[int], bool] | None = None, closest: bool = False) -> tuple[dict[int, int], set[int]]:
        """All entries within the distance that the value's length allows, among those that fit, with their least distance over all alias paths; and
        those (two at most) that the value is the beginning of. With ``closest`` entries further off than the closest may be missing."""
        typed = plain(text)
        words = self.behead(typed)
        found, cut = self._near(words, typed, fits, closest)
        if not found and not cut and (named := self.without_tail(words)) and named != words:
            found, cut = self._near(named, typed, fits, closest)
        return found, cut

    def _near(self, words: list[str], typed: list[str], fits: Callable[[int], bool] | None, closest: bool) -> tuple[dict[int, int], set[int]]:
        bare, named, whole = self.bare(words), " ".join(words), " ".join(typed)
        # a value that ends in a joining word goes on: without that word it is further off than what it is the beginning of
        goes_on = (CUT_COST + 1) * bool(words and words[-1] in STOP)
        # the whole value, for a head typed past recognition, only where the name alone finds nothing; few errors before many: what is found so
        # is closest, and costs a part of the whole search
        found: dict[int, int] = {}
        for forms in ([(self.trie, bare, goes_on)] + [(self.trie, named, 0)] * (named != bare), [(self.whole, whole, 0)]):
            done = -1
            for few in (0, 2, len(whole)) if closest else (len(whole),):
                steps = [(trie, form, more, min(few, allowed(len(form)))) for trie, form, more in forms]
                if not words or found or max(k for *_, k in steps) <= done:
                    break
                done = max(k for *_, k in steps)
                for trie, form, more, k in steps:
                    if closest and found:
                        k = min(k, *found.values())
                    for e, d in trie.within(form, k).items():
                        if (fits is None or fits(e)) and found.get(e, d + more + 1) > d + more:
                            found[e] = d + more
        cut: set[int] = set()
        for trie, form in ((self.trie, named), (self.trie, bare), (self.whole, whole)):
            if len(form) >= CUT_LEAST and not cut:
                cut = trie.below(form, fits)
        return found, cut

    def search(self, text: str, fits: Callable[[int], bool] | None = None) -> int:
        """The entry meant, among those that fit, or -1."""
        return meant(*self.entries(text, fits, True))


def meant(found: dict[int, int], cut: set[int]) -> int:
    """The closest entry, where the only one that begins with the value is taken to be ``CUT_COST`` edits away; of equally close ones that one, or none."""
    if len(cut) == 1:
        found = {**found, **{e: min(found.get(e, CUT_COST), CUT_COST) for e in cut}}
    least = min(found.values(), default=0)
    closest = {e for e, d in found.items() if d == least}
    if len(closest) > 1:
        closest &= cut
    return closest.pop() if len(closest) == 1 else NONE


def collect_list(df: DataFrame, *columns: str) -> list[tuple]:
    """The rows of a reference list, behind the check of its size; a longer list is for ``match_long_list``."""
    rows = df.select(*columns).limit(MAX_ENTRIES + 1).collect()
    if len(rows) > MAX_ENTRIES:
        raise ValueError(f"the reference list has more than {MAX_ENTRIES} entries")
    return sorted((tuple(r) for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


def match_columns(df: DataFrame, key: str, inputs: list[str], make: Callable[[], Callable[..., list[tuple[str, int]]]]) -> DataFrame:
    """``field, rec_id, ref_id`` of each row: what the matcher that ``make`` builds once a task gives for the inputs."""
    src = spread(df.select(F.col(key).cast("string").alias("rec_id"), *[F.col(c).cast("string").alias(f"in_{i}") for i, c in enumerate(inputs)]))
    schema = T.StructType([T.StructField("field", T.StringType()), T.StructField("rec_id", T.StringType()), T.StructField("ref_id", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = lru_cache(MEMO)(make())
        for batch in batches:
            rows: list[int] = []
            fields: list[str] = []
            refs: list[int] = []
            for i, values in enumerate(zip(*(batch.column(c).to_pylist() for c in range(1, batch.num_columns)))):
                for name, ref in match(*values):
                    rows.append(i)
                    fields.append(name)
                    refs.append(ref)
            yield pa.RecordBatch.from_arrays(
                [pa.array(fields, pa.string()), batch.column(0).take(pa.array(rows, pa.int64())), pa.array(refs, pa.int32())], schema.names
            )

    return src.mapInArrow(run, schema)


def entries_of(df: DataFrame, key: str, column: str, entries: list[tuple], heads: frozenset[str] = frozenset()) -> DataFrame:
    """``field, rec_id, ref_id, distance`` of all entries within the distance of each value, not only the one meant. ``entries``: id, labels."""

    def make() -> Callable[[str | None], list[tuple]]:
        names = Gazetteer(heads)
        for ident, *labels in entries:
            for label in labels:
                names.add(label, ident)
        return lambda value: [] if value is None else [(column, e, d) for e, d in sorted(names.entries(value)[0].items())]

    src = spread(df.select(F.col(key).cast("string").alias("rec_id"), F.col(column).cast("string").alias("value")).where("value is not null"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = lru_cache(MEMO)(make())
        for batch in batches:
            got = [(i, *found) for i, v in enumerate(batch.column(1).to_pylist()) for found in near(v)]
            at = pa.array([g[0] for g in got], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([g[1] for g in got], pa.string()), batch.column(0).take(at), pa.array([g[2] for g in got], pa.int32()), pa.array([g[3] for g in got], pa.int32())],
                ["field", "rec_id", "ref_id", "distance"],
            )

    return src.mapInArrow(run, "field string, rec_id string, ref_id int, distance int")


def match_long_list(df: DataFrame, key: str, column: str, entries: DataFrame, ident: str, labels: list[str], *, shard: int = MAX_ENTRIES, block: int = VALUE_BLOCK) -> DataFrame:
    """``field, rec_id, ref_id`` for a reference list of any length, with the same meaning as ``Gazetteer.search`` (labels have no heads).

    Entries are dealt to shards, different values to blocks; every block meets every shard in a task of its own, which gives the closest entries of
    each value in the shard. Over the shards the closest one is meant.
    """
    size = lambda n, most: max(1, -(-n // most))
    asked = df.select(F.col(column).cast("string").alias("value")).where("value is not null").distinct()
    listed = entries.select(F.col(ident).cast("int").alias("ident"), F.array(*[F.col(c).cast("string") for c in labels]).alias("labels")).where("ident is not null")
    shards, blocks = size(listed.count(), shard), size(asked.count(), block)
    left = asked.withColumn("b", F.pmod(F.xxhash64("value"), F.lit(blocks)).cast("int")).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    right = listed.withColumn("ls", F.pmod(F.xxhash64("ident"), F.lit(shards)).cast("int")).withColumn("lb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    schema = "value string, ref_id int, distance int, cut boolean"
    empty = pa.schema([("value", pa.string()), ("ref_id", pa.int32()), ("distance", pa.int32()), ("cut", pa.bool_())]).empty_table()

    def search(values: pa.Table, listed: pa.Table) -> pa.Table:
        if not values.num_rows or not listed.num_rows:
            return empty
        names = Gazetteer()
        for e, given in zip(listed.column("ident").to_pylist(), listed.column("labels").to_pylist()):
            for label in given:
                names.add(label, e)
        rows = []
        for v in values.column("value").to_pylist():
            found, cut = names.entries(v, None, True)
            least = min(found.values(), default=None)
            rows += [(v, e, d, e in cut) for e, d in found.items() if d == least] + [(v, e, None, True) for e in cut if found.get(e) != least or least is None]
        return pa.table([list(c) for c in zip(*rows)], empty.schema) if rows else empty

    near = left.groupBy("b", "s").cogroup(right.groupBy("lb", "ls")).applyInArrow(search, schema)
    # a value has the closest entries of a shard, and two that it begins at most: few rows a value, folded to the one meant
    cuts = F.count_if("cut")
    one_cut = F.when(cuts == 1, F.max(F.when(F.col("cut"), F.col("ref_id"))))
    least = F.least(F.min("distance"), F.when(cuts == 1, F.lit(CUT_COST)))
    folded = near.groupBy("value").agg(least.alias("least"), one_cut.alias("only"), F.collect_list(F.struct("ref_id", "distance")).alias("all"))
    closest = F.transform(F.filter("all", lambda x: x["distance"] == F.col("least")), lambda x: x["ref_id"])
    closest = F.array_distinct(F.when(F.col("only").isNotNull() & (F.col("least") == CUT_COST), F.array_append(closest, F.col("only"))).otherwise(closest))
    both = folded.select("value", "only", closest.alias("closest"))
    named = both.select("value", F.when(F.size("closest") == 1, F.col("closest")[0]).when(F.array_contains("closest", F.col("only")), F.col("only")).alias("ref_id"))
    rows = df.select(F.col(key).cast("string").alias("rec_id"), F.col(column).cast("string").alias("value")).where("value is not null")
    return rows.join(named, "value", "left").select(F.lit(column).alias("field"), "rec_id", F.coalesce("ref_id", F.lit(NONE)).alias("ref_id"))
