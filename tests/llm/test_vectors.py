import numpy as np
from pyspark.sql import functions as F

from corvane.llm import vectors
from corvane.llm.quantise import Quantiser, unit
from corvane.llm.vectors import similar_pairs


def brute(rows, k, least):
    x = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == 16 and all(a is not None and np.isfinite(a) for a in v) and any(v):
            x.setdefault(i, np.array(v, np.float32).astype(float))
    ids = sorted(x)
    u = unit(np.array([x[i] for i in ids]))
    g = u @ u.T
    out = set()
    for a in range(len(ids)):
        order = sorted((b for b in range(len(ids)) if b != a), key=lambda b: (-round(g[a, b], 9), ids[b]))[:k]
        out |= {tuple(sorted((ids[a], ids[b]))) for b in order if g[a, b] >= least}
    return out


def clustered(rng, n, d=16):
    centres = rng.normal(size=(n // 8, d))
    return centres[rng.integers(0, len(centres), n)] + 0.25 * rng.normal(size=(n, d))


def rows_of(x):
    return [(f"v{i:05}", [float(a) for a in r]) for i, r in enumerate(x)]


SCHEMA = "id string, vector array<float>, node string"


def run(spark, rows, k=5, least=0.9):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(3)
    got = [tuple(r) for r in similar_pairs(df, "id", "vector", dims=16, k=k, least=least).collect()]
    assert len(got) == len(set(got)) and all(a < b for a, b in got)
    return set(got)


def test_recall_against_brute_force(spark):
    rows = rows_of(clustered(np.random.default_rng(3), 3000))
    rows += [("z1", None), ("z2", []), ("z3", [1.0]), ("z4", [0.0] * 16), ("z5", [float("nan")] * 16), ("z6", [None] * 16), (None, rows[0][1]), rows[4]]
    got, want = run(spark, rows), brute(rows, 5, 0.9)
    assert len(got & want) / len(want) >= 0.97 and len(got & want) / len(got) >= 0.97


def test_blocks_of_large_cells_give_the_same(spark, monkeypatch):
    rows = rows_of(clustered(np.random.default_rng(4), 600))
    whole = run(spark, rows)
    monkeypatch.setattr(vectors, "BLOCK", 40)
    assert run(spark, rows) == whole


def test_different_vectors_of_one_hash_stay_apart(spark, monkeypatch):
    rows = rows_of(clustered(np.random.default_rng(4), 300))
    whole = run(spark, rows)
    monkeypatch.setattr(vectors, "_name", lambda v: F.pmod(F.xxhash64(v), F.lit(7)))
    got = run(spark, rows)
    assert len(got & whole) >= 0.97 * len(whole | got)


def test_fine_cells_keep_recall(spark, monkeypatch):
    rows = rows_of(clustered(np.random.default_rng(8), 3000))
    monkeypatch.setattr(vectors, "TRAIN", 1024)
    monkeypatch.setattr(vectors, "PER_CELL", 64)
    got, want = run(spark, rows), brute(rows, 5, 0.9)
    assert len(got & want) / len(want) >= 0.9


def test_copies(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 16))
    rows = rows_of(x) + [(f"c{i:03}", [float(a) for a in x[0]]) for i in range(30)]
    assert run(spark, rows) == brute(rows, 5, 0.9)


def test_few_and_none(spark):
    assert run(spark, [("a", [1.0] * 16), ("b", [2.0] * 16), ("c", [-1.0] * 16)]) == {("a", "b")}
    assert run(spark, [("a", [1.0] * 16)]) == set()
    assert similar_pairs(spark.createDataFrame([], SCHEMA), "id", "vector", dims=16, k=5, least=0.9).count() == 0


def test_parallel_error_is_what_the_loss_lowers():
    rng = np.random.default_rng(6)
    x = unit(rng.normal(size=(3000, 16)))
    errors = []
    for threshold in (0.001, 0.8):
        q = Quantiser.fit(x, 1, threshold=threshold)
        codes = q.encode(x, 0)
        assert codes.max() < 16
        back = q.centroid(0) + q.centres[np.arange(len(q.centres))[None, :], codes].reshape(len(x), -1)
        errors.append(np.abs(((x - back) * x).sum(1)).mean())
        np.testing.assert_allclose(q.scan(x[:5], codes, 0), back @ x[:5].T, atol=1e-5)
    assert errors[1] < errors[0]
