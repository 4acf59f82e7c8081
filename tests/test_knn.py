"""k-nearest neighbours in blocks, against brute force."""

import math

import numpy as np
import pytest

from geocell import queries
from geocell.operators import knn


@pytest.mark.parametrize("block", [1024, 16])
def test_blocks_do_not_change_the_result(spark, block):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(0, 4, 3)], int(rng.integers(0, 4))) for i in range(150)]  # many ties
    train, test = rows[:100], rows[100:]
    want = {}
    for i, v, label in test:
        near = sorted((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), j, lab) for j, w, lab in train)[:3]
        votes = {}
        for r, (_, _, lab) in enumerate(near):
            n, first = votes.get(lab, (0, r))
            votes[lab] = n + 1, first
        want[i] = label, min(votes, key=lambda x: (-votes[x][0], votes[x][1], x))
    frame = lambda x: spark.createDataFrame(x, "vec_id long, embedding array<double>, label int")
    got = knn.classify(frame(train), frame(test), k=3, block=block).collect()
    assert {r.vec_id: (r.label, r.predicted) for r in got} == want and len(got) == len(want)
    assert knn.classify(frame([]), frame(test)).count() == knn.classify(frame(train), frame([])).count() == 0


def test_no_cap_on_training_rows(spark):
    train = spark.range(100_500).selectExpr("id as vec_id", "array(cast(id as float)) as embedding", "cast(id % 10 as int) as label")
    test = spark.createDataFrame([(-1, [100_400.2], 0)], "vec_id long, embedding array<float>, label int")
    assert [tuple(r) for r in knn.classify(train, test, k=1).collect()] == [(-1, 0, 0)]


def test_scores_by_label(spark):
    rows = [(1, 1), (1, 1), (1, 2), (2, 1), (3, 2)]
    got = {r.label: (r.precision, r.recall, r.f) for r in knn.by_label(spark.createDataFrame(rows, "label int, predicted int")).collect()}
    assert got == {1: (2 / 3, 2 / 3, 4 / 6), 2: (0.0, 0.0, 0.0), 3: (None, 0.0, 0.0)}


def brute(train, test, k):
    """Distances in the order of the values; null where the sizes differ or a vector is not whole."""

    def place(v, j, w):
        if v is None or w is None or len(v) != len(w) or None in v or None in w:
            return 2, 0.0, j
        d = float(np.sqrt(sum((np.float64(a) - np.float64(b)) ** 2 for a, b in zip(v, w, strict=True))))
        return (1, 0.0, j) if np.isnan(d) else (0, d, j)

    want = {}
    for i, v, label in test:
        votes = {}
        for r, (*_, lab) in enumerate(sorted((*place(v, j, w), lab) for j, w, lab in train)[:k]):
            n, first = votes.get(lab, (0, r))
            votes[lab] = n + 1, first
        want[i] = label, min(votes, key=lambda x: (-votes[x][0], votes[x][1], x))
    return want


@pytest.mark.filterwarnings("ignore::RuntimeWarning")
@pytest.mark.parametrize("dims", [3, 200])  # in generated code, and as arrays
def test_bounds_do_not_change_the_result(spark, monkeypatch, dims):
    monkeypatch.setattr(knn, "FIRST", 4)
    monkeypatch.setattr(knn, "MORE", 4)
    rng = np.random.default_rng(5)
    vectors = [[float(x) for x in rng.normal(0, 1, dims)] for _ in range(150)]
    vectors += [vectors[0]] * 60 + [[float(x) for x in rng.integers(0, 2, dims)] for _ in range(40)]  # copies and ties
    vectors += [None, [], [None] * dims, [1.0, None, *[0.0] * (dims - 2)], vectors[1][:-1], vectors[2][:-1]] * 3
    vectors += [[x] * dims for x in (float("nan"), float("inf"), -float("inf"), 1e200, 1e-200, 1e-162)] * 3
    vectors += [[float(1e8 + x)] * dims for x in range(6)]  # squares cancel
    order = rng.permutation(len(vectors))
    rows = [(int(i), vectors[j], int(rng.integers(0, 4))) for i, j in enumerate(order)]
    train, test = [r for r in rows if r[0] % 10 < 7], [r for r in rows if r[0] % 10 >= 7]
    frame = lambda x: spark.createDataFrame(x, "vec_id long, embedding array<double>, label int")
    for k in (1, 2, 7):
        got = knn.classify(frame(train), frame(test), k=k, block=64).collect()
        assert {r.vec_id: (r.label, r.predicted) for r in got} == brute(train, test, k) and len(got) == len(test)


def test_pairs_are_compared_in_generated_code(spark):
    frame = spark.range(400).selectExpr("id as vec_id", "transform(sequence(1, 64), i -> cast(sin(id * i) as float)) as embedding", "cast(id % 3 as int) as label")
    found = knn.classify(frame.where("vec_id < 300"), frame.where("vec_id >= 300"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "zip_with" not in plan and "Python" not in plan and "MapInArrow" not in plan
    assert found.count() == 100


@pytest.mark.parametrize("name", ["knn_by_label", "knn_confusion"])
def test_queries_compare_pairs_in_generated_code(spark, name):
    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    assert "zip_with" not in plan and "MapInArrow" not in plan


@pytest.mark.parametrize("dims", [5, 100])  # one word a bit, and two
def test_products_are_bounded_by_rounded_vectors(spark, dims):
    rng = np.random.default_rng(6)
    vectors = [[float(x) * scale for x in rng.normal(0, 1, dims)] for scale in (1.0, 1e-3, 1e90, 1e-160, 1e-310) for _ in range(12)]
    vectors += [[0.0] * dims, [1.0] + [0.0] * (dims - 1), [-1.0] * dims, [1.0] * dims, [float(x) for x in rng.integers(-2, 3, dims)], vectors[0]]
    rows = spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int")
    found = knn._prepared(rows, dims)
    q, t = (found.select(*[found[c].alias(p + c) for c in found.columns]) for p in ("q_", "t_"))
    pairs = q.crossJoin(t).select("q_vec_id", "t_vec_id", knn._product_at_most(dims).alias("most")).collect()
    assert len(pairs) == len(vectors) ** 2
    for a, b, most in pairs:
        exact, lengths = float(np.dot(vectors[a], vectors[b])), math.hypot(*vectors[a]) * math.hypot(*vectors[b])
        assert exact - 1e-12 * lengths - 1e-300 <= most <= exact + 0.7 * lengths + 1e-300


@pytest.mark.parametrize("name", ["knn_by_label", "knn_confusion"])
def test_pairs_are_dropped_before_their_values_are_read(spark, name):
    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    tests = [line for line in plan.splitlines() if "Filter" in line and "least" in line and "coalesce" in line]
    assert tests and not any(".c0" in line for line in tests)
