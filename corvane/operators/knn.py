"""Exact nearest neighbours of a stated query set against all rows, in blocks; similarity-weighted votes.

A query set of one bounded block goes to the tasks with the code, and the collection is read where it lies. More queries are dealt to blocks, as is
the collection, and every block of queries meets every block of rows in a task of its own; the driver holds none of them. In both forms a task keeps only the
best k of its rows for each query, so what is shuffled after it is k rows a query and task, whatever the collection's size.

Defined cases: null, empty, all-zero and odd-sized vectors and those with NaN score null and are never neighbours; a row
isn't its own neighbour; of equal scores (at nine decimals) the smaller id comes first; an empty side gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from corvane.session import spread

#: Queries that are sent to the tasks with the code, and queries and rows of a block beyond that.
QUERY_BLOCK, ROW_BLOCK = 20_000, 20_000
#: Queries compared with a batch at a time.
STEP = 512


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null where a side is null, zero or of another size."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)


def _rows(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The usable vectors of a column, unit length, and their places."""
    size = np.asarray(pc.fill_null(pc.list_value_length(column), -1))
    at = np.flatnonzero(size == dims)
    x = np.asarray(column.take(pa.array(at)).flatten().cast(pa.float64()).fill_null(float("nan"))).reshape(len(at), dims)
    norm = np.linalg.norm(x, axis=1)
    good = np.isfinite(norm) & (norm > 0)
    return x[good] / norm[good][:, None], at[good]


def nearest(
    corpus: DataFrame, queries: DataFrame, key: str, vector: str, *, k: int | None, least: float | None = None,
    anchored: bool = False, same: bool = False, block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK,
) -> DataFrame:
    """``query_id, id, score, rank`` of the k best of the corpus for every query row; with ``k`` None of all rows of at least the score.

    With ``anchored`` a row counts only while it is open at the query's day: the corpus has ``opened`` and ``closed``
    (null: still open), the queries ``at``, all dates. With ``same`` both have an integer ``klass``; a query that has one keeps to
    rows of that class, one without it takes all.
    """
    if k is None and least is None:
        raise ValueError("without k there must be a least score")
    kind = corpus.schema[key].dataType
    day = lambda c: F.unix_date(c).alias(c)
    extra_c = [day("opened"), day("closed")] * anchored + [F.col("klass").cast("int").alias("klass")] * same
    extra_q = [day("at")] * anchored + [F.col("klass").cast("int").alias("klass")] * same
    asked = queries.where(F.size(vector) > 0).select(key, vector, *extra_q)
    rows = corpus.where(F.size(vector) > 0).select(key, vector, *extra_c)
    schema = T.StructType([T.StructField("query_id", kind), T.StructField("id", kind), T.StructField("score", T.DoubleType())])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])
    search = _search(k, least, anchored, same, arrow)
    first = asked.limit(block + 1).toArrow()  # no more than one block ever comes to the driver
    if first.num_rows <= block:
        best = spread(rows).mapInArrow(lambda batches: search(first, batches), schema)
    else:
        best = _blocks(rows, asked, key, vector, block, row_block).applyInArrow(lambda table, asked: _joined(search, arrow, table, asked), schema=schema)
    rank = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    ranked = best.withColumn("rank", F.row_number().over(rank))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def _blocks(rows: DataFrame, asked: DataFrame, key: str, vector: str, block: int, row_block: int):
    """Every block of rows beside every block of queries. A block is told by the hash of id and vector, so rows under one id don't meet in one."""
    q_blocks, r_blocks = (max(1, -(-df.count() // most)) for df, most in ((asked, block), (rows, row_block)))
    deal = lambda n: F.pmod(F.xxhash64(F.col(key), F.col(vector)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("__r", deal(r_blocks)).withColumn("__q", every(q_blocks))
    # both sides may come from one table: names of its own keep the planner from taking their columns for the same
    right = asked.select(*[F.col(c).alias(f"asked_{c}") for c in asked.columns], deal(q_blocks).alias("__aq")).withColumn("__ar", every(r_blocks))
    return left.groupBy("__q", "__r").cogroup(right.groupBy("__aq", "__ar"))


def _joined(search, schema: pa.Schema, table: pa.Table, asked: pa.Table) -> pa.Table:
    if not table.num_rows or not asked.num_rows:  # a block met by none
        return schema.empty_table()
    found = search(asked.drop_columns(["__aq", "__ar"]), table.drop_columns(["__q", "__r"]).combine_chunks().to_batches())
    return pa.Table.from_batches(found, schema)


def _numbers(column: pa.Array, at: np.ndarray, null: float) -> np.ndarray:
    return np.asarray(column.take(pa.array(at)).cast(pa.float64()).fill_null(null))


def _search(k: int | None, least: float | None, anchored: bool, same: bool, schema: pa.Schema):
    """A search of batches for a table of queries, as function code."""
    floor = -np.inf if least is None else least

    def best(found: pa.Table) -> pa.Table:
        """The k best of each query, ties by id."""
        order = pc.sort_indices(found, [("q", "ascending"), ("key", "descending"), ("id", "ascending")])
        found = found.take(order)
        q = np.asarray(found.column("q"))
        start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, np.int64)
        place = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
        return found.filter(pa.array(place < k))

    def run(table: pa.Table, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = [c.combine_chunks() for c in table.columns]
        ids, vectors = asked[0], asked[1]
        sides = []
        for dims in np.unique(np.asarray(pc.list_value_length(vectors))).tolist() if len(vectors) else []:
            q, q_at = _rows(vectors, int(dims))
            if len(q):
                sides.append((int(dims), q, q_at))
        shape = pa.schema([("q", pa.int64()), ("key", pa.float64()), ("id", schema.field("id").type), ("score", pa.float64())])
        held = shape.empty_table()
        parts: list[pa.Table] = []
        waiting = 0
        # a row must reach this score to be among a query's best so far
        bar = np.full(len(ids), -np.inf)

        def settle() -> None:
            nonlocal held, parts, waiting
            held = best(pa.concat_tables([held, *parts]))
            parts, waiting = [], 0
            q = np.asarray(held.column("q"))
            last = np.flatnonzero(np.r_[q[1:] != q[:-1], True]) if len(q) else np.empty(0, np.int64)
            full = np.bincount(q, minlength=len(bar))[q[last]] == k
            bar[q[last][full]] = np.asarray(held.column("key"))[last][full]

        for batch in batches:
            for dims, q, q_at in sides:
                x, x_at = _rows(batch.column(1), dims)
                if not len(x):
                    continue
                x_ids = batch.column(0).take(pa.array(x_at))
                own = np.asarray(pc.fill_null(pc.index_in(x_ids, value_set=pc.unique(ids)), -1))
                number = np.asarray(pc.index_in(ids, value_set=pc.unique(ids)))[q_at]
                for i in range(0, len(q), STEP):
                    j = slice(i, i + STEP)
                    score = np.round(q[j] @ x.T, 12)
                    out = number[j, None] == own[None, :]
                    if anchored:
                        now = _numbers(asked[2], q_at, -np.inf)[j, None]
                        out |= (_numbers(batch.column(2), x_at, np.inf)[None, :] > now) | (_numbers(batch.column(3), x_at, np.inf)[None, :] <= now)
                    if same:
                        mine = _numbers(asked[-1], q_at, np.nan)[j, None]
                        out |= ~np.isnan(mine) & ~(mine == _numbers(batch.column(batch.num_columns - 1), x_at, np.nan)[None, :])
                    score[out] = -np.inf
                    if k is None:
                        r, c = np.nonzero(score >= floor)
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(q_at[r + i])), x_ids.take(pa.array(c)), pa.array(score[r, c])], schema=schema)
                        continue
                    near = np.round(score, 9)
                    edge = bar[q_at[j]]
                    if near.shape[1] > k:  # the k-th best of this batch alone bounds it too; what ties with it stays
                        edge = np.maximum(edge, np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k])
                    r, c = np.nonzero((near >= edge[:, None]) & (score >= floor) & np.isfinite(score))
                    if len(r):
                        parts.append(pa.Table.from_arrays([pa.array(q_at[r + i]), pa.array(near[r, c]), x_ids.take(pa.array(c)), pa.array(score[r, c])], schema=shape))
                        waiting += len(r)
                        if waiting > max(1_000_000, 4 * held.num_rows):
                            settle()
            if k is not None and parts:
                settle()
        if k is not None:
            yield from pa.Table.from_arrays([ids.take(held.column("q").combine_chunks()), held.column("id"), held.column("score")], schema=schema).to_batches()

    return run


def vote(neighbours: DataFrame, voters: DataFrame, *, klass: str = "label") -> DataFrame:
    """``query_id, predicted, weight``: the class with the greatest sum of scores among a query's neighbours.

    ``voters`` has ``id`` and the class; a row with two classes votes for both. A tie goes to the smaller class.
    """
    sums = neighbours.join(voters.select("id", klass), "id").groupBy("query_id", klass).agg(F.sum("score").alias("weight"))
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("weight", 6)), klass)
    return sums.withColumn("n", F.row_number().over(best)).where("n = 1").select("query_id", F.col(klass).alias("predicted"), "weight")


def first_seen(hits: DataFrame, *by: str) -> DataFrame:
    """Of hits of several query vectors (``query_no, rank, id, score``) the first of each id, for each value of the columns named: the earlier vector's, not the better score."""
    w = Window.partitionBy(*by, "id").orderBy("query_no", "rank")
    return hits.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def rerank(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """``query_id, id, score, rank`` by the scores a reranker gave; candidates it left out, and scores of none, are dropped."""
    best = candidates.select("query_id", "id").join(scores.select("query_id", "id", "score"), ["query_id", "id"])
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return best.withColumn("rank", F.row_number().over(w))
