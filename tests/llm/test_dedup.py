"""Exact and near duplicates against brute force."""

import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from noctua.llm import exact_dedup, simhash
from tests.llm import edge
from tests.oracle import assert_same


def groups_of(rows):
    found = defaultdict(list)
    for r in rows:
        found[re.sub(r"[\x20\x09-\x0D]", "", r.text or "")].append(r)
    return found


def test_exact_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "RANGE_ROWS", 10)
    docs = edge.documents(spark)
    wanted = Counter()
    for bare, rows in groups_of(docs.select("doc_id", "text").collect()).items():
        best = min(rows, key=lambda r: (-len(r.text or ""), r.doc_id is None, r.doc_id or 0))
        for r in rows:
            wanted[(r.doc_id, best.doc_id, len(rows), hashlib.sha256(bare.encode()).hexdigest())] += 1
    found = exact_dedup.annotate(docs).collect()
    assert Counter((r.id, r.keep_id, r.group_size, bytes(r.digest)[:32].hex()) for r in found) == wanted
    assert sum(r.kept for r in found) == len(groups_of(docs.select("doc_id", "text").collect()))


def test_exact_keeps_one_whole_row_of_each_group(spark):
    docs = edge.documents(spark)
    kept = exact_dedup.keep(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert all(len(g) == 1 for g in groups_of(rows).values()) and len(rows) == len(groups_of(docs.collect()))
    assert exact_dedup.keep(edge.documents(spark, empty=True)).count() == 0


def test_exact_same_as_sql(spark, sf_dir):
    assert_same(spark, sf_dir, exact_dedup.op7_exact_dedup, exact_dedup.SQL)


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def near_copies(spark):
    docs = edge.documents(spark).collect()
    base = [r.text for r in docs if r.text and 30 < len(r.text.split()) < 100][:8]
    more = [(500 + 20 * i + k, t + " zz" * k) for i, t in enumerate(base) for k in range(6)]
    return spark.createDataFrame([(r.doc_id, r.text) for r in docs] + more, "doc_id long, text string").repartition(4)


@pytest.mark.parametrize("group", [32_768, 4])
def test_near_against_brute_force(spark, monkeypatch, group):
    """With groups of 4, band values are dealt out as pairs of tiles."""
    monkeypatch.setattr(simhash, "GROUP", group)
    docs = near_copies(spark)
    rows = docs.collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    roots = brute_components(fps, 2)
    least = {}
    for r, root in zip(rows, roots):
        least[root] = min([x for x in (least.get(root), r.doc_id) if x is not None], default=None)
    wanted = Counter((r.doc_id, f, least[root]) for r, f, root in zip(rows, fps, roots))
    found = simhash.annotate(docs).collect()
    assert Counter((r.id, r.fp & (1 << 64) - 1, r.component_id) for r in found) == wanted
    assert sum(r.kept for r in found) == len(set(roots)) < len(set(fps))


def brute_similar(texts, least=0.8):
    """Components of all pairs of texts whose sets of five-word shingles are that similar."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            union = len(sets[i] | sets[j])
            if root[i] != root[j] and (not union or len(sets[i] & sets[j]) >= least * union):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    return root


def test_similar_against_brute_force(spark):
    """Only similar texts are put together, and nearly all that are: fingerprints must propose them."""
    docs = near_copies(spark)
    rows = docs.collect()
    roots = brute_similar([r.text for r in rows])
    found = simhash.annotate_similar(docs).collect()
    group = defaultdict(set)
    for r, root in zip(rows, roots):
        group[root].add(r.doc_id)
    whole = {d: min((x for x in g if x is not None), default=None) for g in group.values() for d in g}
    assert len(found) == len(rows)
    assert all(r.component_id is None or whole[r.component_id] == whole[r.id] for r in found)  # no group is too large
    assert sum(r.kept for r in found) <= len(group) * 1.02 + 1


@pytest.mark.parametrize("group, pairs", [(32_768, 16), (32_768, 1000), (300, 0)])
def test_similar_finds_all_pairs_within_the_radius(spark, monkeypatch, group, pairs):
    """Texts that share a long passage: unlike ones lie between similar ones, whose links must not be lost with theirs."""
    monkeypatch.setattr(simhash, "SETS", group)
    monkeypatch.setattr(simhash, "GROUP", group)  # with 300, band values are dealt out as pairs of tiles
    monkeypatch.setattr(simhash, "PAIRS", pairs)
    rng = np.random.default_rng(8)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for i in range(1200):
        tail = [f"t{i // 3}x{k}" for k in range(int(rng.integers(8, 30)))]
        own = [f"o{i}x{k}" for k in range(int(rng.integers(0, 10)))]
        texts.append(" ".join(passage + tail + own))
    fps = np.array([brute_fingerprint(t) for t in texts], np.uint64)
    sets = [set(simhash.shingle_set(t).tolist()) for t in texts]
    edges, unlike = [], 0
    for i in range(len(texts)):
        for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= 11).tolist():
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                edges.append((i, j))
            else:
                unlike += 1
    assert unlike > 1000 and len(edges) > 100
    root = list(range(len(texts)))
    for i, j in edges:
        if root[i] != root[j]:
            x, y = max(root[i], root[j]), min(root[i], root[j])
            root = [y if r == x else r for r in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert {r.id: r.component_id for r in simhash.annotate_similar(docs).collect()} == dict(enumerate(root))


def test_near_keeps_one_whole_row(spark):
    docs = edge.documents(spark)
    kept = simhash.keep(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(brute_similar([r.text for r in docs.collect()])))
    assert simhash.annotate(edge.documents(spark, empty=True)).count() == 0


def test_bands_and_flips_reach_the_radius(spark):
    fps = [0, 0b1111111111, (1 << 63) | (1 << 40) | (1 << 20) | 7, sum(1 << k for k in range(0, 64, 6))]
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    found = simhash.links(spark.createDataFrame(signed, "fp long"), 11, bands=4, flips=1).collect()
    assert {x for r in found for x in (r.a, r.b)} == {x for (x,) in signed}  # all are within 11 bits of zero
    assert len({r.root for r in simhash.components(spark.createDataFrame(found)).collect()}) == 1
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame(signed, "fp long"), 12, bands=4, flips=1)


@pytest.mark.parametrize("bands, flips", [(3, 0), (4, 1), (5, 1)])
def test_a_pair_is_told_once(bands, flips):
    """Of all values under which two fingerprints meet, one is the first."""
    rng = np.random.default_rng(2)
    width = 64 // bands
    cuts = [(i * width, width if i < bands - 1 else 64 - (bands - 1) * width) for i in range(bands)]
    for _ in range(200):
        a = int(rng.integers(0, 1 << 63)) * 2 + 1
        b = a
        for k in rng.choice(64, rng.integers(0, 2 + 3 * flips), replace=False):
            b ^= 1 << int(k)

        def stands(v):
            found = []
            for band, (at, bits) in enumerate(cuts):
                x = v >> at & (1 << bits) - 1
                found += [(band, x)] + [(band, x ^ 1 << k) for k in range(bits) if flips]
            return set(found)

        meet = sorted(stands(a) & stands(b))
        x, y = (np.array([v], np.uint64).view(np.int64) for v in (a, b))
        told = [m for m in meet if simhash.first_meeting(x, y, cuts, flips, *m)[0]]
        assert told == meet[:1]


def test_forest_connects_what_is_near():
    rng = np.random.default_rng(0)
    centres = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (30, 100), dtype=np.uint64)
    fps = np.unique(np.concatenate([centres[:, None] ^ flips, centres[:, None]], axis=1))
    order = np.argsort(np.bitwise_count(fps), kind="stable")
    reach, sizes = simhash.Reach(2), np.zeros(len(fps), np.int64)
    a, b = reach.forest(fps, sizes, order, order)
    assert len(a) == len(fps) - 30  # a spanning tree of each of the 30 groups, not their pairs
    half = len(order) // 2
    x, y = reach.forest(fps, sizes, order[:half], order[half:])
    assert len(x) <= len(fps)


def test_components_of_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200) if i != 77] + [(300, 5)], "a long, b long")
    found = {r.node: r.root for r in simhash.components(edges).collect()}
    assert set(found) == set(range(1, 201)) - {78} | {300}
    assert all(root == (0 if node < 78 or node == 300 else 78) for node, root in found.items())


WHOLE = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(f"{WHOLE}/documents.parquet") and not os.path.isfile(f"{WHOLE}/documents.parquet"), reason="the generated tables are not here")
def test_recall_over_true_pairs_however_the_table_is_split(spark):
    """All pairs of similar texts of a larger table are found, but for the few that fingerprints do not propose.

    Pairs come from shingles that texts share; the rows kept do not depend on partitions.
    """
    docs = exact_dedup.keep(spark.read.parquet(f"{WHOLE}/documents.parquet")).select("doc_id", "text").cache()
    sets = {r.doc_id: frozenset(simhash.shingle_set(r.text).tolist()) for r in docs.collect()}
    holders = defaultdict(list)
    for d, own in sets.items():
        for h in own:
            holders[h].append(d)
    tried, pairs = set(), []
    for own in holders.values():
        if 1 < len(own) < 300:
            tried.update((a, b) for i, a in enumerate(own) for b in own[:i])
    for a, b in tried:
        both = len(sets[a] & sets[b])
        if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
            pairs.append((a, b))
    assert len(pairs) > 30
    kept = set()
    for parts, shuffles in ((3, "9"), (13, "4")):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
        found = {r.id: (r.component_id, r.kept) for r in simhash.annotate_similar(docs.repartition(parts)).collect()}
        spark.conf.set("spark.sql.shuffle.partitions", before)
        together = [found[a][0] == found[b][0] for a, b in pairs]
        long = [t for t, (a, b) in zip(together, pairs) if min(len(sets[a]), len(sets[b])) >= 200]
        assert np.mean(together) >= 0.9 and np.mean(long) >= 0.9
        # nothing is joined but by chains of similar texts
        root = {d: d for d in found}

        def top(d):
            while root[d] != d:
                d = root[d]
            return d

        for a, b in pairs:
            root[max(top(a), top(b))] = min(top(a), top(b))
        empty = min((d for d in found if not sets[d]), default=None)
        assert all(top(d) == found[d][0] or found[d][0] == empty for d in found if found[d][0] != d)
        kept.add(frozenset(d for d, (_, k) in found.items() if k))
    assert len(kept) == 1


def test_near_query_as_registered(spark, sf_dir):
    """op2 over the whole table: fingerprints, their digits and components by plain loops."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    fps = {d: brute_fingerprint(t) for d, t in docs.items()}
    root = {d: d for d in docs}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in docs:
        for b in docs:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op2_simhash(spark, sf_dir).collect()}
    assert found == {d: (f"{fps[d]:016x}", top(d)) for d in docs}


def test_of_repeated_rows_one_is_returned(spark):
    from noctua.llm.common import only

    rows = [(1, "a", i % 2) for i in range(500)] + [(None, None, 3)] * 40 + [(2, "b", 4), (3, "c", 5), (1, "b", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `odd.name` int").repartition(7)
    known = docs.selectExpr("doc_id AS id", "xxhash64(text) AS exact", "doc_id IS NULL OR doc_id <> 3 AS kept")
    found = only(docs, "doc_id", "text", known)
    assert found.columns == docs.columns and sorted((tuple(r)[:2] for r in found.collect()), key=str) == sorted([(1, "a"), (1, "b"), (2, "b"), (None, None)], key=str)


def families(spark):
    """Texts of all degrees of likeness: families of copies with words changed, a passage that many share, none, one word."""
    rng, rows = random.Random(8), []
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(3, 6)))
    passage = [word() for _ in range(70)]
    for family in range(6):
        base = [word() for _ in range(rng.choice([30, 80, 150]))]
        for _ in range(rng.choice([2, 5, 40])):
            own = list(base)
            for _ in range(rng.randint(0, 5)):
                own[rng.randrange(len(own))] = word()
            rows.append(" ".join(own[: len(own) - rng.randint(0, 4)]))
    rows += [" ".join(passage + [word() for _ in range(rng.randint(0, 40))]) for _ in range(60)]
    rows += [" ".join(word() for _ in range(60)) for _ in range(40)] + ["", " ", None, "one", "One", "two words", "a b c d e", "a b c d f"] + rows[:3]
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


@pytest.mark.parametrize("listed, sets, buckets", [(33, 4096, 20), (2, 4096, 20), (2, 8, 4), (5, 8, 20)])
def test_copies_against_brute_force(spark, monkeypatch, listed, sets, buckets):
    """All pairs of 0.8 or more, whether they are listed or met in groups, however rarity is judged and tables are split."""
    monkeypatch.setattr(simhash, "LISTED", listed)
    monkeypatch.setattr(simhash, "SETS", sets)
    monkeypatch.setattr(simhash, "BUCKETS_LOG2", buckets)
    monkeypatch.setattr(simhash, "SENT", 0 if listed == 5 else simhash.SENT)
    docs = families(spark)
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    wanted = brute_similar(texts)
    found = {r.id: r for r in simhash.annotate_copies(docs.repartition(5)).collect()}
    assert [found[i].component_id for i in range(len(texts))] == list(wanted)
    assert sorted(i for i, r in found.items() if r.kept) == sorted(set(wanted))


def test_listed_pairs_grow_with_the_table(spark):
    """Twice the texts, about twice the pairs: texts that share a frequent passage do not all meet."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    passage = " ".join(word() for _ in range(60))
    texts = [" ".join([passage] * (i % 3 == 0) + [word() for _ in range(90)]) for i in range(4000)]
    met = []
    for n in (1000, 2000, 4000):
        sets = spark.createDataFrame([(i, bytearray(simhash.shingle_set(t).tobytes())) for i, t in enumerate(texts[:n])], "node long, shingles binary")
        met.append(simhash.met(simhash.filed(sets, simhash.shingle_counts(sets), 0.8), 0.8).count())
    assert met[2] <= 5 * max(met[0], 200) and met[2] < 0.001 * 4000**2


def test_copies_on_awkward_rows(spark):
    docs = edge.documents(spark)
    found = simhash.annotate_copies(docs).collect()
    assert len(found) == docs.count() and simhash.annotate_copies(edge.documents(spark, empty=True)).count() == 0
    kept = simhash.keep(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in found)


def test_copies_are_proposed_by_fingerprints_first(spark, monkeypatch):
    """Where shingles propose nothing, SimHash alone finds pairs within NEAR bits that are similar."""
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join([*words[:-1], "x"]), " ".join(words[::-1])]
    near = {i for i in (1, 2) if (simhash.fingerprint(texts[0]) ^ simhash.fingerprint(texts[i])).bit_count() <= simhash.NEAR}
    assert near == {1}
    monkeypatch.setattr(simhash, "met", lambda filing, similarity: filing.sparkSession.createDataFrame([], ", ".join(f"{c} bigint" for c in simhash.MET_NAMES)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.id: r.component_id for r in simhash.annotate_copies(docs).collect()} == {0: 0, 1: 0, 2: 2}


def test_components_shuffle_few_links_in_few_parts(spark, monkeypatch):
    """Parts of the links' tables follow from how many links there are, not from the shuffle's parts."""
    monkeypatch.setattr(simhash, "LINKS", 30)
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 100) if i % 10 < 9], "a bigint, b bigint").repartition(16)
    found = simhash.components(edges)
    assert {(r.node, r.root) for r in found.collect()} == {(i, i - i % 10) for i in range(100) if i % 10}
    assert found.rdd.getNumPartitions() <= 3
