"""Quality counters against brute force, and the verdicts."""

import re
from collections import Counter

import numpy as np
import pytest

from noctua.llm import quality
from tests.llm import edge


def counters(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered |= set(range(i, i + 8))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_counters(spark):
    docs = edge.documents(spark)
    phrase = "one two three four five six seven eight "
    extra = spark.createDataFrame([(900, phrase * 2 + "# $x a&b <c> | *", "en"), (901, "w " * 50, "en"), (902, phrase + "nine ten " + phrase + "x " * 3, None)], "doc_id long, text string, lang string")
    docs = docs.select("doc_id", "text", "lang").union(extra)
    found = quality.judge(docs, quality.large_ones(quality.references(docs))).collect()
    wanted = Counter((r.doc_id, *counters(r.text)) for r in docs.collect())
    assert Counter((r.id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found) == wanted
    assert not any(r.kept and r.base_failed for r in found)
    empty = edge.documents(spark, empty=True)
    assert quality.judge(empty, quality.large_ones(quality.references(empty))).count() == 0


def test_distance():
    p, q = np.array([1.0, 0, 3]), np.array([0.0, 2, 0])
    assert quality.distance(p, p * 5) == 0 and quality.distance(p, q) == 1 and quality.distance(p, np.zeros(3)) == 1
    assert quality.distance(np.array([1.0, 1]), np.array([1.0, 0])) == pytest.approx(0.5579, abs=1e-3)


def test_references_are_exact(spark):
    docs = edge.documents(spark).select("doc_id", "text", "lang").where("lang IN ('en', 'fr')")
    found = quality.large_ones(quality.references(docs.repartition(5)))
    for lang in ("en", "fr"):
        words, classes = Counter(), np.zeros(len(quality.CLASSES))
        for r in docs.collect():
            if r.lang == lang and r.text:
                words.update(w.strip(quality.MARKS) for w in r.text.encode().lower().split())
                classes += quality.class_counts(r.text.encode())
        total = words.total()
        common = sorted((w for w, n in words.items() if n >= quality.SHARE * total and w), key=lambda w: (-words[w], w))[: quality.COMMON]
        own, at, histogram = found[lang]
        assert (own == classes).all() and sorted(at, key=at.get) == common
        assert histogram.tolist() == [*(words[w] for w in common), total - sum(words[w] for w in common)]


def test_verdicts_follow_the_labels(spark, sf_dir):
    found = {r.doc_id: r for r in quality.op9_quality(spark, sf_dir).collect()}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    clean = [found[x.doc_id] for x in labels if x.quality and not found[x.doc_id].base_failed]
    junk = [found[x.doc_id] for x in labels if not x.quality]
    assert all(r.kept for r in clean)
    assert sum(not r.kept for r in junk) >= 0.5 * len(junk)


def test_short_texts_are_not_judged_by_histograms(spark):
    reference = {"en": (np.array([0.0] * 8 + [1]), {b"the": 0}, np.array([1.0, 0]))}
    docs = spark.createDataFrame([(1, "word " * 3 + "abc def ghi jkl mno pqr stu vwx yz a b c d e f g h i", "en"), (2, " ".join(f"w{i}" for i in range(200)), "xx")], "doc_id long, text string, lang string")
    short, long = quality.judge(docs, reference).orderBy("id").collect()
    assert short.kept and short.class_distance is None and short.word_distance is None
    assert not long.kept and long.word_distance == 1.0
    assert all(r.kept for r in quality.judge(docs, {}).collect())


def test_small_languages_have_their_own_reference(spark, tmp_path):
    """A language of under a thousandth of the rows is not judged by another one."""
    rng = np.random.default_rng(4)
    text = lambda letter, n: " ".join(f"{letter}{k}" for k in rng.integers(0, 40, n))
    rows = [(i, text("e", 12 if i % 10 else 150), "en") for i in range(4000)] + [(5000 + i, text("z", 150), "zz") for i in range(2)] + [(6000, "only two", "yy"), (6001, None, "xx")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4).write.parquet(f"file://{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in quality.op9_quality(spark, f"file://{tmp_path}").collect()}
    assert len(found) == len(rows)
    assert all(found[5000 + i].kept and found[5000 + i].word_distance < 0.45 for i in range(2))
    assert not found[6000].kept and found[6001].word_distance is None


@pytest.mark.parametrize("block", [1, 1000])
def test_rows_without_a_language_meet_small_references(spark, block):
    """As if all references were sent: none of a small language is passed over."""
    rng = np.random.default_rng(6)
    text = lambda letter, n=150: " ".join(f"{letter}{k}" for k in rng.integers(0, 40, n))
    rows = [(i, text("e"), "en") for i in range(40)] + [(100 + i, text(x), f"{x}{x}") for x in "xyz" for i in range(2)] + [(200 + i, text(x), None) for i, x in enumerate("exyzq")] + [(300, None, None), (201, text("x"), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    found = quality.references(docs)
    large = quality.large_ones(found, 4)
    assert list(large) == ["en"]
    own = quality.judge_without_language(docs, large, found.where("lang <> 'en'"), block=block)
    every = quality.judge(docs.where("lang IS NULL"), quality.large_ones(found, 10**6))
    assert own.columns == every.columns and sorted(map(str, own.collect())) == sorted(map(str, every.collect()))
    assert sorted((r.id, r.kept) for r in own.collect()) == [(200, True), (201, True), (201, True), (202, True), (203, True), (204, False), (300, False)]


def test_references_by_join_are_those_sent(spark, monkeypatch):
    """The same verdicts, whether a language's reference is broadcast or joined, and if tasks hold few words."""
    docs = edge.documents(spark).select("doc_id", "text", "lang").where("lang IS NOT NULL")
    key = lambda r: str(tuple(r))
    sent = sorted(quality.judge(docs, quality.large_ones(quality.references(docs))).collect(), key=key)
    monkeypatch.setattr(quality, "HELD", 5)
    joined = sorted(quality.judge(docs, {}, small=quality.references(docs)).collect(), key=key)
    assert sent == joined and len(sent) == docs.count()


def brute_verdicts(rows):
    """kept and both distances of each row, by counting everything anew in plain Python."""
    kinds = {"lower": "[a-z]", "upper": "[A-Z]", "beyond": "[^\x00-\x7f]", "digit": "[0-9]", "blank": "[ \t\x0b\x0c\r]", "break": "\n", "mark": r"[.,;:!?\"'()\-]", "symbol": r"[#*$%&|<>]"}

    def classes(text):
        found = Counter({k: len(re.findall(p, text)) for k, p in kinds.items()})
        # lead bytes of two to four make one character; what is left is the class of all others
        found["other"] = len(text) - found.total()
        return found

    def words(text):
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text)
        return [w.strip(".,;:!?\"'()") for w in re.findall(r"[^\x20\x09-\x0D]+", lower)]

    def far(p, q):
        a, b, out = sum(p.values()), sum(q.values()), 0.0
        if not a or not b:
            return 1.0
        for k in set(p) | set(q):
            x, y = p.get(k, 0) / a, q.get(k, 0) / b
            out += sum(v * np.log2(2 * v / (x + y)) for v in (x, y) if v) / 2
        return max(out, 0) ** 0.5

    per_lang, of_words = {}, {}
    for r in rows:
        if r.lang is not None and r.text is not None:
            per_lang.setdefault(r.lang, Counter()).update(classes(r.text))
            of_words.setdefault(r.lang, Counter()).update(words(r.text))
    common = {k: sorted((w for w in c if w and 1000 * c[w] >= c.total()), key=lambda w: (-c[w], w.encode()))[:100] for k, c in of_words.items()}
    fold = lambda lang, c: Counter({w: c[w] for w in common[lang]}) + Counter({None: c.total() - sum(c[w] for w in common[lang])})
    for r in rows:
        n, *_, failed = counters(r.text)
        near = [r.lang] if r.lang in per_lang else list(per_lang) if r.lang is None else []
        by_class = min((far(classes(r.text), per_lang[k]) for k in near), default=None) if n >= 50 else None
        by_word = min((far(fold(k, Counter(words(r.text))), fold(k, of_words[k])) for k in near), default=None) if n >= 100 else None
        yield r.doc_id, not failed and (by_class is None or by_class <= 0.30) and (by_word is None or by_word <= 0.45), by_class, by_word


def test_query_against_brute_force(spark, sf_dir):
    found = {r.doc_id: r for r in quality.op9_quality(spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(found) == len(rows)
    for (doc, kept, by_class, by_word), r in zip(brute_verdicts(rows), rows):
        own = found[doc]
        assert (own.n_words, own.word_chars, own.n_symbols, own.n_dup_lines, own.n_repeat_words, own.base_failed) == counters(r.text)
        assert (own.class_distance is None, own.word_distance is None) == (by_class is None, by_word is None)
        assert by_class is None or own.class_distance == pytest.approx(by_class, abs=1e-6)
        assert by_word is None or own.word_distance == pytest.approx(by_word, abs=1e-6)
        assert own.kept == kept
