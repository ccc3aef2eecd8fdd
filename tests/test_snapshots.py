import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators.snapshots import Bitmap, Ordinals, key_ordinals, snapshot_changes

SCHEMA = "source string, snapshot_no int, id string, a string, code string, n int, loaded_at timestamp, __bucket string"
T0 = datetime(2024, 1, 1)


def row(s, no, i, a="x", code="1", n=1, at=0):
    return (s, no, i, a, code, n, None if at is None else T0 + timedelta(hours=at), "clash")


def changes(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    return {tuple(r) for r in snapshot_changes(df, ["a", "code", "n"], codes=["code"], **kw).collect()}


def test_bitmap_against_sets():
    rng = np.random.default_rng(1)
    for n, top in ((0, 10), (50, 1000), (6000, 70_000), (90_000, 200_000)):
        a, b = (np.unique(rng.integers(0, top, n)) for _ in range(2))
        x, y = Bitmap.of(a), Bitmap.of(b)
        assert x.and_not(y).tolist() == sorted(set(a.tolist()) - set(b.tolist()))
        assert x.and_(y).tolist() == sorted(set(a.tolist()) & set(b.tolist()))


def test_defined_cases(spark):
    rows = [
        row("S", 1, "k1"), row("S", 1, "k2", a=None), row("S", 1, "k3", code="007 "), row("S", 1, "k4", a="old"), row("S", 1, "k4", a="new", at=5), row("S", 1, "k5"),
        row("S", 3, "k1", a=" x "), row("S", 3, "k2", a=""), row("S", 3, "k3", code="7"), row("S", 3, "k4", a="new"), row("S", 3, "k6"), row("S", 3, "k6"),
        row("S", 4, "k1", a=None), row("S", 4, "k2", a="v"), row("S", 4, "k3", code="8"), row("S", 4, "k4", a="new", n=None), row("S", 4, "k6"),
        row("T", 9, "k1"), row(None, 1, "k1"), row("S", None, "k1"), row("S", 4, None),
    ]
    want = {("S", 3, "k5", "removed"), ("S", 3, "k6", "added"), *[("S", 4, k, "changed") for k in ("k1", "k2", "k3", "k4")]}
    assert changes(spark, rows) == want
    assert changes(spark, rows, bucket_rows=1) == want


def test_no_rows_left_in_a_bucket(spark):
    rows = [row("S", 1, "only1"), row("S", 2, "only2"), row("S", 3, "only3", at=None)]
    want = {("S", 2, "only1", "removed"), ("S", 2, "only2", "added"), ("S", 3, "only2", "removed"), ("S", 3, "only3", "added")}
    assert changes(spark, rows, bucket_rows=1) == want


def test_empty(spark):
    assert changes(spark, []) == set()


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = [row(s, no, f"k{i}", a=rng.choice(["p", "q", None]), n=rng.randint(1, 2), at=rng.randint(0, 9)) for s in "AB" for no in (1, 2, 5) for i in range(60) for _ in range(rng.choice([0, 1, 1, 2]))]
    latest = {}
    for r in rows:
        key = r[:3]
        if key not in latest or (r[6], r[3] is not None, r[3] or "", r[5]) > (latest[key][6], latest[key][3] is not None, latest[key][3] or "", latest[key][5]):
            latest[key] = r
    want = set()
    for s in "AB":
        nos = sorted({k[1] for k in latest if k[0] == s})
        for before, no in zip(nos, nos[1:]):
            a, b = ({k[2]: r[3:6] for k, r in latest.items() if k[:2] == (s, x)} for x in (before, no))
            want |= {(s, no, k, "added") for k in b.keys() - a.keys()} | {(s, no, k, "removed") for k in a.keys() - b.keys()}
            want |= {(s, no, k, "changed") for k in a.keys() & b.keys() if a[k] != b[k]}
    assert changes(spark, rows, bucket_rows=50) == want


def dictionary(df):
    return {(r["source"], r["id"]): (hash_bucket(r["id"], r["buckets"], df.sparkSession), r["ordinal"]) for r in df.collect()}


def hash_bucket(key, buckets, spark, seen={}):
    if key not in seen:
        seen[key] = spark.range(1).select(F.xxhash64(F.lit(key))).first()[0]
    return seen[key] % buckets


def test_ordinals_persist(spark):
    day = lambda no: [row("S", no, f"k{i}") for i in range(20 + no)] + [row("T", no, "k0"), row("S", no, None)]
    first = key_ordinals(spark.createDataFrame(day(1), SCHEMA), 3)
    second = key_ordinals(spark.createDataFrame(day(9), SCHEMA), None, first)
    a, b = dictionary(first), dictionary(second)
    assert len(a) == 22 and len(b) == 30 and all(b[k] == v for k, v in a.items())
    for s, bucket in {(k[0], v[0]) for k, v in b.items()}:
        assert sorted(v[1] for k, v in b.items() if (k[0], v[0]) == (s, bucket)) == list(range(sum((k[0], v[0]) == (s, bucket) for k, v in b.items())))
    rows = day(1) + day(9) + [row("S", 10, "k3", a="other")]
    assert changes(spark, rows, known=first) == changes(spark, rows, buckets=3) == changes(spark, rows, known=second)
    df = spark.createDataFrame(rows, SCHEMA)  # a dictionary of the very table
    assert {tuple(r) for r in snapshot_changes(df, ["a", "code", "n"], codes=["code"], known=key_ordinals(df, 3)).collect()} == changes(spark, rows)
    for bad in (lambda: changes(spark, rows, known=first, buckets=4), lambda: key_ordinals(spark.createDataFrame(rows, SCHEMA), 4, first)):
        with pytest.raises(ValueError):
            bad()


def test_stored_ordinals_past_more_buckets(spark, tmp_path):
    kept = Ordinals(spark, str(tmp_path / "o"))
    day = lambda no, n: [row("S", no, f"k{i}", a=str(i % no)) for i in range(n)]
    want, rows, before = set(), [], {}
    for no, n in ((2, 10), (3, 40), (4, 200)):
        rows += day(no, n)
        df = spark.createDataFrame(rows, SCHEMA)
        known = kept.extend(df, bucket_rows=30)
        now = {(r["source"], r["id"]): r["ordinal"] for r in known.collect()}
        assert all(now[k] == v for k, v in before.items())  # also where the buckets became more
        held = {(hash_bucket(k[1], known.first()["buckets"], spark), v) for k, v in now.items()}
        assert len(held) == len(now) == n
        assert changes(spark, rows, known=known) == changes(spark, rows)
        assert changes(spark, rows[:3], known=known) == changes(spark, rows[:3])  # buckets without rows
        assert kept.extend(df, bucket_rows=30).inputFiles() == known.inputFiles()  # nothing new, nothing written
        before = now
    assert known.first()["buckets"] == 16
