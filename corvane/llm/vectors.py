"""The most similar vectors for every vector of a collection, by cosine.

Equal vectors are one node. Nodes lie in the cells of the centroids nearest to them; within a cell four-bit table scans pick the candidates,
which are compared exactly. A cell of more than ``BLOCK`` nodes is dealt to blocks, and every two blocks meet in one task, so no task
holds an unbounded cell.

The centroids and centres are fitted on at most ``TRAIN`` rows, the first by hash of the id; every row is indexed.

Defined cases
* Null, empty, shortened or lengthened and all-zero vectors, and those with a null, NaN or infinite number take no part.
* Rows repeated under one id count once; an id with several vectors takes part with each.
* Of equal cosines the smaller id is the more similar one; a vector's copies come first, with cosine 1.
* Fewer vectors than neighbours asked for: all are neighbours. An empty table gives an empty result.
* Columns other than id and vector aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.quantise import Quantiser, unit
from corvane.session import spread, stage

#: Rows the index is fitted on, at most.
TRAIN = 65_536
#: Hash values the sample is drawn by.
SLOTS = 1 << 20
#: Training rows per cell, at least.
PER_CELL = 16
#: Nodes of a cell, about; beyond as many cells as the training rows allow, cells are divided by fine centroids, so many at most.
CELL, MOST_FINE = 128, 1024
#: Cells a node lies in.
SPILL = 2
#: Nodes in a block of a large cell.
BLOCK = 4096
#: The share of true neighbours that the slack of the table scan may lose.
LOSS = 0.001


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def usable(df: DataFrame, key: str, vector: str, dims: int) -> DataFrame:
    """``id, vector`` of the vectors that can be compared."""
    v = F.col("vector")
    return (
        df.select(F.col(key).cast("string").alias("id"), F.col(vector).cast("array<float>").alias("vector"))
        .where(F.col("id").isNotNull() & (F.size(v) == dims))
        .where(~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0))
    )


def fit(nodes: DataFrame, count: int, seed: int = 7) -> Quantiser | None:
    """A quantiser from a bounded sample of the nodes."""
    cells = max(1, count // CELL)
    coarse = min(cells, TRAIN // PER_CELL)
    fine = min(-(-cells // coarse), MOST_FINE)
    most = min(TRAIN, max(4096, coarse * 2 * PER_CELL))
    # a threshold on the hash draws them in the scan: nothing is sorted or brought together but the sample
    share = min(SLOTS, int(SLOTS * 1.1 * most / max(count, 1)) + 64)
    drawn = F.pmod(F.xxhash64("node", F.lit(11)), F.lit(SLOTS))
    sample = nodes.where(drawn < share).select("node", "vector").limit(4 * most).toArrow()
    if not sample.num_rows:
        return None
    order = np.argsort(np.asarray(sample.column("node").combine_chunks()))[:most]
    x = unit(_matrix(sample.column("vector").combine_chunks().take(pa.array(order))))
    q = Quantiser.fit(x, coarse, fine=fine, seed=seed)
    q.measure(x[:4096], 1 - LOSS)
    return q


def _cells(nodes: DataFrame, model: Quantiser, spill: int, vectors: bool) -> DataFrame:
    """``cell, node`` (and the vector) of every node in its nearest cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(_matrix(batch.column(1))).astype(np.float32)
            near = model.nearest_cells(x, spill)
            rows = pa.array(np.repeat(np.arange(len(x)), near.shape[1]))
            out = [pa.array(near.reshape(-1).astype(np.int32)), batch.column(0).take(rows)]
            if vectors:
                out.append(batch.column(1).take(rows))
            yield pa.RecordBatch.from_arrays(out, ["cell", "node", "vector"][: len(out)])

    return nodes.select("node", "vector").mapInArrow(run, "cell int, node bigint" + ", vector array<float>" * vectors)


def _neighbours(table: pa.Table, model: Quantiser, k: int, least: float) -> pa.Table:
    """The k nearest within a cell, or between two of its blocks, and ties of the last."""
    cell, i, j = (table.column(c)[0].as_py() for c in ("cell", "i", "j"))
    node = np.asarray(table.column("node"))
    part = np.asarray(table.column("part"))
    x = unit(_matrix(table.column("vector").combine_chunks()))
    left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
    found_a, found_b, found_s = [], [], []

    def top(q_at: np.ndarray, s_at: np.ndarray) -> None:
        codes = model.encode(x[s_at], cell)
        for b in range(0, len(q_at), 512):
            q = q_at[b : b + 512]
            rough = model.scan(x[q], codes, cell)
            s, c = np.nonzero(rough >= least - model.slack)
            s, q2 = s_at[s], q[c]
            other = node[s] != node[q2]
            s, q2 = s[other], q2[other]
            exact = np.einsum("nd,nd->n", x[s], x[q2])
            good = exact >= least
            s, q2, exact = s[good], q2[good], exact[good]
            order = np.lexsort((-exact, q2))
            s, q2, exact = s[order], q2[order], exact[order]
            start = np.searchsorted(q2, q2)
            last = np.minimum(start + k - 1, len(q2) - 1)
            fits = (np.arange(len(q2)) - start < k) | ((q2[last] == q2) & (exact >= exact[last]))
            found_a.append(node[q2[fits]])
            found_b.append(node[s[fits]])
            found_s.append(exact[fits])

    if len(left) and len(right):
        top(left, right)
        if i != j:
            top(right, left)
    cat = lambda p, t: np.concatenate(p) if p else np.empty(0, t)
    return pa.table({"a": cat(found_a, np.int64), "b": cat(found_b, np.int64), "cosine": cat(found_s, np.float64)})


def similar_nodes(nodes: DataFrame, *, k: int, least: float, spill: int = SPILL) -> DataFrame | None:
    """``a, b, cosine``: for each node its k most similar others with at least the cosine, with ties of the last."""
    model = fit(nodes, nodes.count())
    if model is None:
        return None
    nodes = spread(nodes)
    # how many nodes each large cell has is joined to its rows: there may be any number of them
    sizes = stage(_cells(nodes, model, spill, False).groupBy("cell").count().where(F.col("count") > BLOCK), "cells")
    placed = _cells(nodes, model, spill, True)
    if not sizes.isEmpty():
        n = F.coalesce(F.ceil(F.col("count") / BLOCK).cast("int"), F.lit(1))
        placed = placed.join(sizes, "cell", "left").withColumn("n", n)
        placed = placed.withColumn("part", F.pmod(F.xxhash64("node", F.lit(3)), F.col("n")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        placed = placed.select("cell", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node", "vector")
    else:
        placed = placed.select("cell", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("part"), "node", "vector")
    return placed.groupBy("cell", "i", "j").applyInArrow(lambda t: _neighbours(t, model, k, least), "a bigint, b bigint, cosine double")


def _name(vector: Column) -> Column:
    return F.xxhash64(vector)


def _nodes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows with the name of their vector's node, and the nodes: a vector each. Two hashes make equal: different vectors of one name, of which there are
    hardly any, get another one from both."""
    named = rows.withColumn("node", _name(F.col("vector"))).withColumn("check", F.xxhash64("vector", F.lit(1)))
    group = lambda df: stage(df.groupBy("node").agg(F.first("vector").alias("vector"), F.min("check").alias("lo"), F.max("check").alias("hi")), "nodes")
    nodes = group(named)
    shared = nodes.where("lo <> hi").select("node")
    if not shared.isEmpty():
        shared = stage(shared.withColumn("shared", F.lit(True)), "shared")
        named = named.join(shared, "node", "left").withColumn("node", F.when(F.col("shared"), F.xxhash64("node", "check")).otherwise(F.col("node"))).drop("shared")
        nodes = group(named)
    return named.select("id", "node"), nodes.select("node", "vector")


def similar_pairs(df: DataFrame, key: str, vector: str, *, dims: int, k: int, least: float, spill: int = SPILL) -> DataFrame:
    """``id_a, id_b`` (the smaller first) where one is among the other's k most similar and their cosine is at least ``least``."""
    spark = df.sparkSession
    rows, nodes = _nodes(usable(df, key, vector, dims))
    members = stage(rows.select("node", "id").distinct(), "members")
    near = similar_nodes(nodes, k=k, least=least, spill=spill)
    if near is None:
        return spark.createDataFrame([], "id_a string, id_b string")
    first = Window.partitionBy("node").orderBy("id")
    chosen = members.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k + 1)
    rep = chosen.where("rank = 1").select(F.col("node").alias("b"), F.col("id").alias("rep"))
    best = Window.partitionBy("a").orderBy(F.desc("cosine"), "rep")
    near = near.dropDuplicates(["a", "b"]).join(rep, "b").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("a", "b", "cosine")
    copies = chosen.where("rank = 2").select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(1.0).alias("cosine"))
    pairs = (
        near.union(copies)
        .join(members.select(F.col("node").alias("a"), F.col("id").alias("x")), "a")
        .join(chosen.select(F.col("node").alias("b"), F.col("id").alias("y")), "b")
        .where("x <> y")
    )
    most = Window.partitionBy("x").orderBy(F.desc("cosine"), "y")
    return (
        pairs.select("x", "y", "cosine")
        .withColumn("rank", F.row_number().over(most))
        .where(F.col("rank") <= k)
        .select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
        .distinct()
    )
