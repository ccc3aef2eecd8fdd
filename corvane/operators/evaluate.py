"""Scores of retrieval and attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTS = (1, 3, 5, 10, 20)


def of_mates(ranked: DataFrame, queries: DataFrame, rows: DataFrame, group: str) -> tuple[DataFrame, DataFrame]:
    """Hits among mates, and how many mates each query has, where mates are the other rows of a query's group.

    ``ranked``: query_id, id, rank; ``queries`` and ``rows``: id and group, rows of distinct ids. The groups are only counted: no pair
    of mates is ever made, so a group may hold any share of the rows. Queries without mates are left out.
    """
    sizes = rows.groupBy(group).agg((F.count("*") - 1).alias("n")).where("n > 0")
    asked = queries.select(F.col("id").alias("query_id"), F.col(group).alias("__own")).join(sizes.withColumnRenamed(group, "__own"), "__own").select("query_id", "__own", "n")
    hits = ranked.join(rows.select("id", F.col(group).alias("__its")), "id").join(asked.select("query_id", "__own"), "query_id")
    return hits.where(F.col("__own") == F.col("__its")).select("query_id", "id", "rank"), asked.select("query_id", "n")


def of_pairs(ranked: DataFrame, mates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same for mates given as pairs: query_id, id."""
    truth = mates.select("query_id", "id").distinct()
    return ranked.select("query_id", "id", "rank").join(truth, ["query_id", "id"], "left_semi"), truth.groupBy("query_id").agg(F.count("*").alias("n"))


def hit_recall(hits: DataFrame, sizes: DataFrame, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """``k, n_queries, hit, recall`` from the hits among mates and the numbers of mates."""
    counts = hits.groupBy("query_id").agg(*[F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in cuts])
    by = sizes.join(counts, "query_id", "left").fillna(0, [f"h{k}" for k in cuts])
    long = by.select("query_id", "n", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"h{k}").alias("h")) for k in cuts])).alias("x"))
    return (
        long.groupBy(F.col("x.k").alias("k"))
        .agg(F.count("*").alias("n_queries"), F.round(F.avg((F.col("x.h") > 0).cast("double")), 4).alias("hit"), F.round(F.avg(F.col("x.h") / F.col("n")), 4).alias("recall"))
    )


def rank_buckets(hits: DataFrame, sizes: DataFrame) -> DataFrame:
    """``bucket, n`` of the rank of each query's first true one."""
    r = F.col("rank")
    bucket = F.when(r == 1, "1").when(r <= 3, "2-3").when(r <= 5, "4-5").when(r <= 10, "6-10").when(r <= 20, "11-20").otherwise("miss")
    return first_ranks(hits, sizes).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def upper_median(name: str) -> Column:
    """The element at half the count of a column's sorted values: from above, the first that half of them reach.

    The aggregate keeps a count of each distinct value, not the values.
    """
    return F.expr(f"percentile_disc(0.5) within group (order by `{name}` desc)")


def first_ranks(hits: DataFrame, sizes: DataFrame) -> DataFrame:
    """``query_id, rank`` of each query's first true one, null for none."""
    return sizes.select("query_id").join(hits.groupBy("query_id").agg(F.min("rank").alias("rank")), "query_id", "left")


def threshold_recall(scored: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """``threshold, recall, hit`` from ``query_id, score`` of all siblings; a sibling without a vector has a null score and counts."""
    by = scored.groupBy("query_id").agg(F.count("*").alias("n"), *[F.count_if(F.col("score") >= t).alias(f"t{i}") for i, t in enumerate(thresholds)])
    long = by.select("n", F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"t{i}").alias("h")) for i, t in enumerate(thresholds)])).alias("x"))
    return long.groupBy(F.col("x.threshold").alias("threshold")).agg(
        F.round(F.avg(F.col("x.h") / F.col("n")), 4).alias("recall"), F.round(F.avg((F.col("x.h") > 0).cast("double")), 4).alias("hit")
    )


def compare(truth: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Per class and in TOTAL: n, hits and percentages of two predictions, and their difference.

    ``truth``: query_id, klass, a row per true class; the predictions: query_id, predicted.
    """
    a, b = (p.select("query_id", F.col("predicted").alias(f"p{i}")) for i, p in enumerate((first, second)))
    rows = truth.join(a, "query_id", "left").join(b, "query_id", "left")
    hit = lambda i: F.count_if(F.col(f"p{i}") == F.col("klass"))
    out = rows.rollup("klass").agg(F.count("*").alias("n"), hit(0).alias("hits_a"), hit(1).alias("hits_b"), F.grouping("klass").alias("__g"))
    pct = lambda h: F.round(100 * F.col(h) / F.col("n"), 1)
    return out.select(
        F.when(F.col("__g") == 1, "TOTAL").otherwise(F.col("klass").cast("string")).alias("klass"),
        "n", "hits_a", "hits_b", pct("hits_a").alias("pct_a"), pct("hits_b").alias("pct_b"),
        F.round(100 * (F.col("hits_b") - F.col("hits_a")) / F.col("n"), 1).alias("delta"),
    )


def diverse_failures(failures: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The first failure of each group before any second one, up to n."""
    w = Window.partitionBy(group).orderBy(order)
    return failures.withColumn("turn", F.row_number().over(w)).orderBy("turn", order).limit(n)


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows by the hash of key and seed: the same ones on every run and layout."""
    return df.orderBy(F.sha2(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")), 256), key).limit(n)
