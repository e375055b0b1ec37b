import hashlib

import numpy as np
import pytest

from strataspark.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int, id string, code string, v string"


def brute(vectors, labels, parts=4, entries=256, rounds=4):
    """(codes, errors, label errors, codebooks) by measuring everything in Python's integers; vectors in order of ids."""
    x = np.floor(np.asarray(vectors, float) * 1024).astype(np.int64).reshape(len(vectors), parts, -1)
    books = [x[:entries, p].copy() for p in range(parts)]
    for r in range(rounds + 1):
        codes, error = [], np.zeros(len(x), np.int64)
        for p in range(parts):
            far = ((x[:, p, None] - books[p][None]) ** 2).sum(axis=2)
            codes.append(far.argmin(axis=1))
            error += far.min(axis=1)
            if r < rounds:
                for k in range(len(books[p])):
                    own = x[codes[p] == k, p]
                    if len(own):
                        books[p][k] = [int(s) // len(own) for s in own.sum(axis=0)]
    sums = {}
    for e, label in zip(error.tolist(), labels, strict=True):
        sums[label] = sums.get(label, 0) + e
    return ["".join(f"{c[i]:02x}" for c in codes) for i in range(len(x))], error.tolist(), [sums[label] for label in labels], books


def frame(spark, vectors, labels, ids=None):
    rows = [(i, [float(v) for v in x] if x is not None else None, y, "a", "b", "c") for i, x, y in zip(ids or range(len(vectors)), vectors, labels, strict=True)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def same(codes, books, want):
    got = codes.orderBy("vec_id").collect()
    assert ([r.code for r in got], [r.error for r in got], [r.label_error for r in got]) == tuple(want[:3])
    assert np.array_equal(books, np.stack(want[3]))


def test_query_against_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    want = brute([r.embedding for r in rows], [r.label for r in rows])
    got = V.op12_vector_code_compression(spark, sf).orderBy("vec_id").collect()
    sha = hashlib.sha256(",".join(str(v) for b in want[3] for v in b.ravel()).encode()).hexdigest()
    assert [(r.code, r.error, r.label_error, r.codebooks_sha256) for r in got] == [(*x, sha) for x in zip(*want[:3], strict=True)]


def test_ties_copies_and_hot_labels(spark, monkeypatch):
    """Small integers make many equal distances; a third of the rows is one vector, labels are null or hot."""
    rng = np.random.default_rng(1)
    x = rng.integers(-2, 3, (600, 8)) / 1024
    x[200:400] = x[0]
    labels = [None if i % 3 == 0 else i % 2 for i in range(600)]
    same(*V.compress(frame(spark, x, labels), entries=40, rounds=5), brute(x, labels, entries=40, rounds=5))
    monkeypatch.setattr(V, "HOT_SHARE", 2.0)
    same(*V.compress(frame(spark, x, labels), entries=7, rounds=1), brute(x, labels, entries=7, rounds=1))


def test_bounds_pass_over_most_entries_and_stay_true():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(m, 20, (300, 16)) for m in rng.normal(0, 300, (30, 16))]).round()
    c = x[rng.permutation(len(x))[:64]]
    state, measured = V.first_bounds(x, c), []
    for _ in range(4):
        new = np.stack([np.floor(x[state.code == k].mean(axis=0)) if (state.code == k).any() else c[k] for k in range(64)])
        state, n = V.next_bounds(x, new, state, V.up(np.sqrt(((new - c) ** 2).sum(axis=1))))
        far = np.sqrt(V.squared(x, new))
        c = new
        measured.append(n)
        assert np.array_equal(state.code, far.argmin(axis=1))
        assert (state.upper >= far.min(axis=1)).all() and (state.lower() <= far).all()
    assert max(measured) < 0.5 * x.shape[0] * 64 and measured[-1] < 0.1 * x.shape[0] * 64


def test_rows_that_are_dropped_and_few_rows(spark):
    nan, inf = float("nan"), float("inf")
    x = [[1.0, 2, 3, 4], None, [1.0, nan, 0, 0], [0.0, inf, 1, 1], [-0.5, 0.25, -0.0001, 9.0], [1.0, 2, 3, 4]]
    df = frame(spark, x, [1, 2, 3, 4, None, 1])
    null = spark.createDataFrame([(9, [1.0, None, 1.0, 1.0], 1, "a", "b", "c")], SCHEMA)
    kept = [x[0], x[4], x[5]]
    same(*V.compress(df.union(null)), brute(kept, [1, None, 1]))
    assert [r.vec_id for r in V.compress(df.union(null))[0].orderBy("vec_id").collect()] == [0, 4, 5]
    empty, books = V.compress(df.where("false"))
    assert empty.columns == ["vec_id", "code", "error", "label", "label_error"] and empty.count() == 0 and books.size == 0
    assert V.compress(df.where("vec_id = 1"))[0].count() == 0


def test_ids_that_are_null_or_repeat(spark):
    """Equal ids begin the codebook in the order of their vectors, null ids last."""
    x = [[3.0, 0, 0, 0], [1.0, 0, 0, 0], [2.0, 0, 0, 0], [0.0, 0, 0, 0]]
    codes, books = V.compress(frame(spark, x, [0, 0, 0, 0], [5, 5, None, 7]), entries=3, rounds=0)
    assert books[0, :, 0].tolist() == [1024, 3072, 0] and codes.where("vec_id IS NULL").count() == 1


def test_numbers_that_need_integers_and_errors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 40000, (50, 8)).astype(np.float32)
    assert V.number_kind(int(abs(x).max() * 1024) + 1, 2) is np.int64
    same(*V.compress(frame(spark, x, [0] * 50), entries=5), brute(x, [0] * 50, entries=5))
    with pytest.raises(ValueError, match="too large"):
        V.compress(frame(spark, [[1e30] * 4], [0]))
    with pytest.raises(ValueError, match="one length"):
        V.compress(frame(spark, [[1.0] * 4, [1.0] * 8], [0, 0]))
    with pytest.raises(ValueError, match="one length"):
        V.compress(frame(spark, [[1.0] * 6], [0]))
