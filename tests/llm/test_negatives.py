"""Hard negatives against SQL, and against plain loops over awkward rows; the product against Python's integers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from noctua.llm import negatives
from tests.oracle import assert_same


@pytest.mark.parametrize("shape", [(1, 1, 1), (40, 9, 33), (65, 64, 70), (128, 17, 50), (33, 100, 35), (0, 64, 40)])
@pytest.mark.parametrize("most", [300, 1 << 62])
def test_product_is_exact(shape, most):
    m, k, n = shape
    rng = np.random.default_rng(k)
    a, b = rng.integers(-most, most, (m, k)), rng.integers(-most, most, (k, n))
    wanted = [[(sum(int(x) * int(y) for x, y in zip(row, column)) + (1 << 63)) % (1 << 64) - (1 << 63) for column in b.T] for row in a]
    assert negatives.strassen(a, b).tolist() == wanted


def test_same_as_sql(spark, sf_dir):
    assert_same(spark, sf_dir, negatives.op12_hard_negatives, negatives.SQL)


SCHEMA = "vec_id long, embedding array<float>, label int, id string, row string, v int, slot int, score string"


def awkward():
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.integers(-40, 60, 6) / 64], int(rng.integers(0, 3))) for i in range(240)]
    rows += [(300 + i, list(rows[0][1]), 1 + i % 2) for i in range(30)]  # copies of an anchor's vector, many ties
    rows += [rows[50], rows[50], rows[7]]  # repeated rows, one of them an anchor
    rows += [(None, [1.0] * 6, 0), (350, None, 1), (351, [1.0, None], 1), (400, [float("nan")] * 6, 1), (450, [float("inf"), 1.0], 2), (500, [0.5] * 6, None), (550, [], 1), (600, [0.75, 0.5], 0), (650, [2.0] * 9, 1)]
    return rows


def brute(rows, positives=5, most=3):
    """Plain loops over whole-number products."""
    part = []
    for i, v, label in rows:
        if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            part.append((i, [int(np.floor(256 * float(np.float32(x)))) for x in v], (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    out = []
    for n, (i, v, label) in enumerate(part):
        if i is None or i % 50:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(v, w)), j is None, j or 0, k) for m, (j, w, k) in enumerate(part) if m != n))
        near = [s for s in scored if s[3] == label][:positives]
        for p in near:
            inside = [s for s in scored if s[3] != label and 50 * -p[0] <= 100 * -s[0] <= 95 * -p[0]][:most]
            out += [(i, None if p[1] else p[2], r, None if s[1] else s[2], -p[0], -s[0]) for r, s in enumerate(inside, 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("cell", [negatives.CELL, 300])
def test_awkward_rows(spark, monkeypatch, cell):
    monkeypatch.setattr(negatives, "CELL", cell)
    rows = awkward()
    table = spark.createDataFrame([(*r, "i", "r", 1, 2, "s") for r in rows], SCHEMA).repartition(3)
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    found = negatives.mine(table, F.col("id") % 50 == 0, label)
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows)


def test_empty_table(spark):
    assert negatives.mine(spark.createDataFrame([], SCHEMA), F.col("id") % 50 == 0, F.col("label")).count() == 0


def test_huge_scores_keep_their_windows(spark):
    """Hundredths of scores near the end of 64 bits do not overflow."""
    rows = [(0, [1e8], 1), (1, [1e6], 1), (2, [9e5], 2), (3, [4.9e5], 2), (4, [9.51e5], 2), (5, [5e5], 2)]
    table = spark.createDataFrame([(*r, "i", "r", 1, 2, "s") for r in rows], SCHEMA)
    found = negatives.mine(table, F.col("id") % 50 == 0, F.col("label"), scale=256)
    assert [(r.positive_id, r.negative_id) for r in found.orderBy("rank").collect()] == [(1, 2), (1, 5)]
