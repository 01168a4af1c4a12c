"""Sharding by an exact hypergeometric matrix, and Pfair mixing."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from noctua.llm import mixing, sharding
from tests.llm import edge
from tests.oracle import assert_same


def test_hypergeometric_has_its_mean_and_variance():
    rng = random.Random(1)
    good, bad, n = 300, 700, 100
    draws = [sharding.hypergeometric(rng, good, bad, n) for _ in range(20_000)]
    mean = sum(draws) / len(draws)
    var = sum((d - mean) ** 2 for d in draws) / len(draws)
    assert mean == pytest.approx(30, abs=0.2) and var == pytest.approx(n * 0.3 * 0.7 * 900 / 999, rel=0.05)
    assert {sharding.hypergeometric(rng, 2, 1, 2) for _ in range(200)} == {1, 2}
    assert sharding.hypergeometric(rng, 5, 0, 3) == 3 and sharding.hypergeometric(rng, 0, 5, 3) == 0
    assert 0 <= sharding.hypergeometric(rng, 10**10, 10**12, 10**8) <= 10**8


def test_matrix_sums_are_exact():
    matrix = sharding.draw_matrix([7, 0, 100, 13], [40, 40, 40], 3)
    assert [sum(r) for r in matrix] == [7, 0, 100, 13] and [sum(c) for c in zip(*matrix)] == [40, 40, 40]


@pytest.mark.parametrize("rows", [20_000, 7])
def test_shards(spark, monkeypatch, rows):
    monkeypatch.setattr(sharding, "PART_ROWS", rows)
    docs = edge.documents(spark)
    found = sharding.shard(docs.drop("text"), shards=7)
    assert found.columns == [c for c in docs.columns if c not in ("text", "slot")] + ["shard", "slot"]
    slots = defaultdict(list)
    for r in found.collect():
        slots[r.shard].append(r.slot)
    sizes = [len(slots[s]) for s in range(7)]
    assert sum(sizes) == docs.count() and max(sizes) - min(sizes) <= 1
    assert all(sorted(own) == list(range(len(own))) for own in slots.values())
    again = sharding.shard(docs.drop("text").repartition(9), shards=7)
    assert sorted(map(str, again.collect())) == sorted(map(str, found.collect()))  # however the rows were read
    assert sharding.shard(edge.documents(spark, empty=True)).count() == 0


def test_equal_rows_share_no_part(spark, monkeypatch):
    """Of 3000 rows 2000 are equal: no window holds more than a few parts' worth, and reading has no say."""
    monkeypatch.setattr(sharding, "PART_ROWS", 100)
    rows = spark.range(1000).selectExpr("id", "CAST(id AS STRING) AS t").unionByName(spark.range(2000).selectExpr("7 AS id", "'same' AS t"))
    base, copy = sharding.numbered_copies(rows.repartition(6), ["id", "t"], 3000)
    numbers = sorted(r.copy for r in base.where("t = 'same'").collect())
    assert copy == ["copy"] and numbers == list(range(1, 2001)) and base.where("t <> 'same'").agg({"copy": "max"}).first()[0] == 0
    parts = base.groupBy(F.pmod(F.xxhash64(F.lit(28), "id", "t", *copy), F.lit(30))).count().agg({"count": "max"}).first()[0]
    assert parts < 180
    found = sharding.shard(rows.repartition(6), shards=4)
    sizes = Counter(r.shard for r in found.collect())
    assert set(sizes.values()) == {750}
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, sharding.shard(rows.repartition(11), shards=4).collect()))


def test_shuffle_is_uniform(spark):
    """Every row reaches every shard and every half of a shard about equally often over seeds."""
    base = spark.range(64)
    shards, halves = Counter(), Counter()
    for seed in range(25):
        for r in sharding.shard(base, shards=4, seed=seed).collect():
            shards[r.id % 8, r.shard] += 1
            halves[r.id % 8, r.slot < 8] += 1
    assert all(25 < n < 78 for n in shards.values()) and len(shards) == 32  # 50 each is expected
    assert all(70 < n < 130 for n in halves.values())


@pytest.mark.parametrize("part_rows", [20_000, 16])
def test_deal_against_plain_python(spark, monkeypatch, part_rows):
    """The same deal, row by row, from the same matrix and the same hashes."""
    monkeypatch.setattr(sharding, "PART_ROWS", part_rows)
    n, shards, seed = 300, 5, 11
    base = spark.range(n)
    keys = base.select("id", *(F.xxhash64(F.lit(seed * 4 + salt), "id").alias(f"k{salt}") for salt in range(4))).collect()
    parts, buckets = -(-n // part_rows), max(1, -(-n // (shards * part_rows)))
    of_part = defaultdict(list)
    for r in keys:
        of_part[r.k0 % parts].append(r)
    capacities = [n // shards + (s < n % shards) for s in range(shards)]
    matrix = sharding.draw_matrix([len(of_part[p]) for p in range(parts)], capacities, seed)
    dealt = defaultdict(list)
    for p in range(parts):
        rest = iter(sorted(of_part[p], key=lambda r: (r.k1, r.id)))
        for s, count in enumerate(matrix[p]):
            dealt[s] += [next(rest) for _ in range(count)]
    wanted = {r.id: (s, slot) for s, own in dealt.items() for slot, r in enumerate(sorted(own, key=lambda r: (r.k2 % buckets, r.k3, r.id)))}
    assert {r.id: (r.shard, r.slot) for r in sharding.shard(base, shards, seed).collect()} == wanted


def test_the_query_of_shards(spark, sf_dir):
    found = sharding.op5_sharding(spark, sf_dir)
    sizes = Counter(r.shard for r in found.collect())
    assert set(sizes) == set(range(40)) and set(sizes.values()) == {5}
    import zlib

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in found.collect():
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "rows", None)


def schedule(spark, weights):
    """source, j, a and period of each slot."""
    sources = mixing.classes(mixing.shares(spark.createDataFrame([(k, 1) for k in weights], "source string, n long"), weights))
    own = {(r.a, r.r): r for r in sources.collect()}
    slots = mixing.period(sources).orderBy("t").collect()
    assert [r.t for r in slots] == list(range(slots[0].period))
    k = {r.a: r.k for r in own.values()}
    return [(own[s.a, s.n % k[s.a]].source, s.n // k[s.a], s.a, s.period) for s in slots]


SHARES = [{"a": 1.0}, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 0.6} | {f"t{i}": 0.01 for i in range(40)}, {"a": 1 / 3, "b": 1 / 3, "c": 1 / 3}, {"a": 0.5} | {f"t{i}": 0.5 / 3000 for i in range(3000)}]


@pytest.mark.parametrize("weights", SHARES)
def test_every_prefix_is_within_a_block_of_its_share(spark, weights):
    slots = schedule(spark, weights)
    m, placed, share = slots[0][3], Counter(), {s: a for s, _, a, _ in slots}
    of_share = {a: [s for s in share if share[s] == a] for a in share.values()}
    for t, (source, j, _, _) in enumerate(slots, 1):
        assert j == placed[source]
        placed[source] += 1
        for a, names in of_share.items():  # extremes only: thousands of sources have one share
            some = [source, names[0], names[-1]] if len(names) > 50 else names
            assert all(abs(placed[s] * m - t * share[s]) < m for s in some)
    assert all(placed[s] == share[s] for s in share) and set(share) == set(weights)


def brute_schedule(shares):
    """Slot by slot over all sources: of the blocks whose window has begun, the earliest deadline."""
    m, done, out = sum(shares.values()), Counter(), []
    for t in range(m):
        ready = [(-(-(done[s] + 1) * m // a), a, done[s], s) for s, a in shares.items() if done[s] * m < (t + 1) * a]
        out.append(min(ready)[3])
        done[out[-1]] += 1
    return out


@pytest.mark.parametrize("weights", SHARES[:4])
def test_schedule_against_brute_force(spark, weights):
    slots = schedule(spark, weights)
    assert [s[0] for s in slots] == brute_schedule({s: a for s, _, a, _ in slots})


def test_a_key_of_many_rows_is_spread(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK_ROWS", 50)
    docs = spark.createDataFrame([(None if i % 3 else i, "s", "t") for i in range(3000)], "doc_id long, source string, text string")
    rows = mixing.mix(docs).collect()
    assert len({(r.slot, r.place) for r in rows}) == len(rows) == 3000
    first = sum(r.doc_id is None for r in rows if r.slot < 100)
    assert abs(first / sum(r.slot < 100 for r in rows) - 2 / 3) < 0.1


def test_mix_places_every_row_once(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK_ROWS", 5)
    docs = edge.documents(spark)
    rows = mixing.mix(docs, block=2).collect()
    assert len(rows) == docs.count()
    assert Counter((r.doc_id, r.source) for r in rows) == Counter((r.doc_id, r.source) for r in docs.collect())
    assert len({(r.slot, r.place) for r in rows}) == len(rows)
    assert len({(r.source, r.slot) for r in rows}) == len({r.slot for r in rows}) == len({(r.source, r.block) for r in rows})
    assert mixing.mix(edge.documents(spark, empty=True)).count() == 0


def test_mix_follows_the_weights_until_a_source_runs_out(spark):
    docs = spark.createDataFrame([(i, "big" if i % 4 else "small", "t") for i in range(4000)], "doc_id long, source string, text string")
    rows = mixing.mix(docs, weights={"big": 0.5, "small": 0.5}, block=10).collect()
    slots = {r.slot: r.source for r in rows}
    placed = Counter()
    for t in range(200):
        placed[slots[t]] += 1
        assert abs(placed["small"] - (t + 1) / 2) < 1
    assert set(slots[t] for t in slots if t >= 200) == {"big"}


def test_arranged_rows_keep_columns_and_order(spark):
    docs = edge.documents(spark)
    out = mixing.arranged(docs)
    assert out.columns == docs.columns and sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))
    place = {}
    for r in mixing.mix(docs).collect():
        place[r.doc_id] = min(place.get(r.doc_id, (r.slot, r.place)), (r.slot, r.place))
    order = [place[r.doc_id] for r in out.collect()]
    assert order == sorted(order)


def test_mix_same_as_sql(spark, sf_dir):
    assert_same(spark, sf_dir, mixing.op6_mixing, mixing.SQL)
