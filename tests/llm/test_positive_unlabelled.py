"""The risk against its definition, what is learned from invented texts, and that held-out labels have no say."""

import random

import numpy as np
import pytest

from noctua.llm import positive_unlabelled as pu
from tests.llm import edge


def invented(n=1200, seed=1):
    """doc_id, text, whether it is clean: five of six are; junk has marks in its words, or words over and over."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 8))) for _ in range(rng.randint(30, 120))]
        clean = i % 6 > 0
        if not clean:
            words = [w + rng.choice(["%%%", "$$$"]) for w in words] if i % 12 else [words[0]] * 60
        rows.append((i, " ".join(words).capitalize() + ".", clean))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = invented()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, int(c), 0) for i, _, c in rows if i % 5 < 3], "doc_id long, quality int, toxic int")
    return docs, labels, {i: c for i, _, c in rows}


def test_held_out_accuracy(tables):
    docs, labels, clean = tables
    found = [r for r in pu.classify(docs, labels).collect() if r.held_out]
    assert len(found) > 200 and np.mean([r.predicted == clean[r.doc_id] for r in found]) > 0.97
    good, bad = ([r.score for r in found if clean[r.doc_id] == x] for x in (True, False))
    assert np.mean([[x > y for y in bad] for x in good]) > 0.995


def test_prior_is_found_without_negatives(tables):
    docs, labels, _ = tables
    features = pu.featured(docs)
    model = pu.fit(features, pu.trusted(labels.where("quality = 1"), "doc_id", "quality"))
    assert abs(model.prior - 5 / 6) < 0.08


def test_only_positives_that_are_not_held_out_are_learned(spark, tables):
    """Labels of held-out rows turned round, those that are not 1 removed: nothing changes."""
    docs, labels, _ = tables
    turned = labels.withColumn("h", pu.held_out("doc_id")).selectExpr("doc_id", "CASE WHEN h THEN 1 - quality ELSE quality END AS quality").where("quality = 1")
    a, b = ({r.doc_id: r.score for r in pu.classify(docs, x).collect()} for x in (labels, turned))
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-9


def test_split_has_no_say(tables):
    docs, labels, _ = tables
    a, b = ({r.doc_id: r.score for r in pu.classify(docs.repartition(n), labels).collect()} for n in (1, 40))
    assert max(abs(a[k] - b[k]) for k in a) < 1e-6


def set_of(rng, n, shift):
    x = np.abs(rng.standard_normal((n, pu.WIDTH))) * 0.2 + shift * (np.arange(pu.WIDTH) % 3 == 0)
    return x, pu.Moments(n, x.sum(axis=0), x.T @ x)


def test_risk_is_its_definition():
    rng = np.random.default_rng(2)
    (x, p), (y, u), w, prior = set_of(rng, 50, 0.3), set_of(rng, 80, 0.1), rng.standard_normal(pu.WIDTH) * 0.1, 0.6
    plus, minus, d_plus, d_minus = pu.risk_parts(w, p, u, prior)
    loss = lambda z: np.mean((1 - z) ** 2 / 4)
    assert np.isclose(plus, prior * loss(x @ w)) and np.isclose(minus, loss(-(y @ w)) - prior * loss(-(x @ w)))
    for i in (0, 5, 100):
        e = np.zeros(pu.WIDTH)
        e[i] = 1e-5
        for k, d in ((0, d_plus), (1, d_minus)):
            assert np.isclose((pu.risk_parts(w + e, p, u, prior)[k] - pu.risk_parts(w - e, p, u, prior)[k]) / 2e-5, d[i], atol=1e-6)


def test_minimum_is_that_of_the_normal_equations_where_the_negatives_part_stays_above_zero():
    rng = np.random.default_rng(3)
    (_, p), (_, own), (_, other) = set_of(rng, 4000, 0.1), set_of(rng, 2700, 0.1), set_of(rng, 6300, 0.0)
    u = own + other
    w = pu.minimise(p, u, 0.3)
    exact = np.linalg.solve(u.square + pu.ridge_of(p, u), 2 * 0.3 * p.mean - u.mean)
    value = lambda z: sum(pu.risk_parts(z, p, u, 0.3)[:2]) + z @ pu.ridge_of(p, u) @ z / 4
    assert pu.risk_parts(exact, p, u, 0.3)[1] > 0 and abs(value(w) - value(exact)) < 1e-4


def test_awkward_rows(spark):
    docs = edge.documents(spark)
    labels = spark.createDataFrame([(None, 1), (4, None), (5, 1), (5, 0), (6, 1), (6, 1), (20, 1), (21, 1), (23, 1)], "doc_id long, quality int")
    found = pu.classify(docs, labels)
    assert [x for x, _ in found.dtypes] == ["doc_id", "held_out", "score", "predicted"]
    rows = found.collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert sorted(r.id for r in pu.trusted(labels, "doc_id", "quality").collect()) == [i for i in (6, 20, 21, 23) if not held(spark, i)]
    empty = labels.where("false")
    assert {(r.score, r.predicted) for r in pu.classify(docs, empty).collect()} == {(0.0, 0)}
    assert pu.classify(edge.documents(spark, empty=True), labels).count() == 0


def held(spark, i):
    return spark.createDataFrame([(i,)], "doc_id long").select(pu.held_out("doc_id")).first()[0]


def test_numbers_of_plain_cases():
    blank, same = pu.numbers_of(None), pu.numbers_of("")
    assert np.array_equal(blank, same) and np.isfinite(blank).all()
    junk = pu.numbers_of("aa&& bb&& aa&&\naa&& bb&& aa&&")
    assert junk[8] == 1 and junk[12] == 0.5 and junk[3] == 0
    assert np.all((pu.numbers_of("x " * 50_000)[: pu.NUMERIC] >= 0) & (pu.numbers_of("x " * 50_000)[: pu.NUMERIC] <= 1))
