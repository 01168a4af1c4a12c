"""Quality rules: counters of each text, and how far its histograms lie from those of its language.

Two histograms of a document are compared with the reference of its language by the Jensen-Shannon distance (the
square root of the divergence in bits, 0 to 1): character classes, and the language's most common words with all
other words as one more bin. A document too short for a histogram is not judged by it. References are counted over
all documents of a language, however many or few: tasks count words and characters, and a shuffle adds them up. The
references of large languages (a thousandth of the rows or more, so under a thousand) are sent to the tasks; those of
all others meet their documents in a join.

Null and empty texts have no words and fail the base rules; texts are read whole; repeated rows count and are judged as
often as they come. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noctua.llm.common import cut, look_up, quoted, slices, stored, table

SYMBOLS = b"#*$%&|<>"
MARKS = b".,;:!?\"'()"
CLASSES = ("lower", "upper", "beyond_ascii", "digit", "blank", "break", "mark", "symbol", "other")
#: A word is common in a language from this share of its words; the histogram has this many of them.
SHARE, COMMON = 1 / 1000, 100
#: A language is large if it is that of one in so many documents at least, so there are no more large languages than that.
LANGUAGES = 1000
#: Distinct words that a counting task holds before it passes them on.
HELD = 200_000


def _classes() -> np.ndarray:
    """The class of each byte; continuation bytes of a character have none and come last."""
    of = np.full(256, CLASSES.index("other"), np.uint8)
    for name, members in (("lower", range(97, 123)), ("upper", range(65, 91)), ("beyond_ascii", range(0xC0, 256)), ("digit", range(48, 58)), ("blank", b" \t\x0b\x0c\r"), ("break", b"\n"), ("mark", MARKS + b"-"), ("symbol", SYMBOLS)):
        of[list(members)] = CLASSES.index(name)
    of[0x80:0xC0] = len(CLASSES)
    return of


CLASS_OF = _classes()


@dataclass(frozen=True)
class Rules:
    """Limits. Lengths are in words; distances of the histograms are 0 (equal) to 1."""

    least_words: int = 20
    most_repeated: int = 30
    class_words: int = 50
    class_distance: float = 0.30
    word_words: int = 100
    word_distance: float = 0.45


def class_counts(data: bytes) -> np.ndarray:
    """Code points of each class."""
    return np.bincount(CLASS_OF[np.frombuffer(data, np.uint8)], minlength=len(CLASSES) + 1)[: len(CLASSES)]


def plain(words: list[bytes]) -> list[bytes]:
    return [w.strip(MARKS) for w in words]


def repeated_words(words: list[bytes], size: int = 8) -> int:
    """Words that lie in a window of ``size`` words that occurs twice or more in the text, the first included."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.uint64)
    mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    hashes = np.zeros(n, np.uint64)
    for k in range(size):
        hashes = hashes * np.uint64(0xD6E8FEB86659FD93) + mixed[k : k + n]
    order = np.argsort(hashes, kind="stable")
    same = np.flatnonzero(hashes[order[1:]] == hashes[order[:-1]])
    if not len(same):
        return 0
    at = np.unique(np.concatenate([order[same], order[same + 1]]))
    windows = [ids[i : i + size].tobytes() for i in at.tolist()]  # equal hashes are only a hint
    times = Counter(windows)
    at = at[np.array([times[w] > 1 for w in windows])]
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + size, -1)
    return int((np.cumsum(covered) > 0).sum())


def repeated_lines(data: bytes) -> int:
    lines = [x for x in data.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """The Jensen-Shannon distance of two histograms; 1 if one of them is empty."""
    if not p.sum() or not q.sum():
        return 1.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        bits = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return float(np.sqrt(max(bits.sum() / 2, 0)))


Reference = dict[str, tuple[np.ndarray, dict[bytes, int], np.ndarray]]
WORD, CLASS, TEXT = 0, 1, 2
COUNT = pa.schema([("lang", pa.string()), ("kind", pa.int32()), ("word", pa.binary()), ("n", pa.int64())])


def references(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, texts, classes (histogram), words (the common ones), histogram (of them and all others) of each language.

    Rows without a language or a text do not count.
    """
    pairs = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")

    def rows(words, classes, texts):
        for name, own in words.items():
            facts = [(CLASS, c.encode(), int(n)) for c, n in zip(CLASSES, classes[name])] + [(TEXT, b"", texts[name])]
            kinds, keys, n = zip(*facts)
            k = len(own)
            columns = [[name] * (k + len(facts)), [WORD] * k + [*kinds], [*own, *keys], [*own.values(), *n]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, COUNT.types)], names=COUNT.names)

    def counted(batches):
        words, classes, texts = defaultdict(Counter), defaultdict(lambda: np.zeros(len(CLASSES), np.int64)), Counter()
        for batch in slices(batches):
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = body.encode()
                words[name].update(plain(data.lower().split()))
                classes[name] += class_counts(data)
                texts[name] += 1
            if sum(map(len, words.values())) > HELD:
                yield from rows(words, classes, texts)
                words.clear(), classes.clear(), texts.clear()
        yield from rows(words, classes, texts)

    sums = stored(pairs.mapInArrow(counted, "lang string, kind int, word binary, n bigint").groupBy("lang", "kind", "word").agg(F.sum("n").alias("n")), "references")
    per_class = [F.sum(F.when((F.col("kind") == CLASS) & (F.col("word") == F.lit(c.encode())), F.col("n")).otherwise(0)) for c in CLASSES]
    of_kind = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0))
    facts = cut(sums.groupBy("lang").agg(F.array(*per_class).alias("classes"), of_kind(WORD).alias("total"), of_kind(TEXT).alias("texts"), F.count("*").alias("rows")))
    words = sums.where((F.col("kind") == WORD) & (F.length("word") > 0)).select("lang", "word", "n")
    common = look_up(words, facts.select("lang", "total", "rows"), "lang", "rows", sums.count()).where(F.col("n") >= SHARE * F.col("total"))  # under 1 / SHARE words a language
    common = common.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("place") <= COMMON)
    found = common.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "word", "n"))).alias("found"), F.sum("n").alias("covered"))
    both = facts.join(found, "lang", "left")
    bins = F.concat(F.coalesce("found.n", F.array().cast("array<bigint>")), F.array(F.col("total") - F.coalesce("covered", F.lit(0))))
    return cut(both.select("lang", "texts", "classes", F.coalesce("found.word", F.array().cast("array<binary>")).alias("words"), bins.alias("histogram")))


def large_ones(found: DataFrame, languages: int = LANGUAGES) -> Reference:
    """The references of the languages that have one in so many texts or more; there are no more than that."""
    total = found.agg(F.sum("texts")).first()[0] or 0
    rows = found.where(F.col("texts") >= max(total / languages, 1)).collect()
    return as_reference(rows)


def as_reference(rows: list) -> Reference:
    return {r.lang: (np.array(r.classes, float), {bytes(w): i for i, w in enumerate(r.words)}, np.array(r.histogram, float)) for r in rows}


def judge(docs: DataFrame, reference: Reference, key: str = "doc_id", text: str = "text", lang: str = "lang", rules: Rules = Rules(), small: DataFrame | None = None) -> DataFrame:
    """Counters, distances and verdict of each row. Null texts have no words; they and short ones fail the base rules.

    Rows of a language that is not in ``reference`` are judged by its row of ``small``; of a language without one only
    the base rules count. A row without a language is held against all of ``reference`` and judged by the nearest, as is
    one of another language if ``small`` is not given (judge_without_language() holds it against small languages too). Without any reference only the base rules count. Distances are
    null where a histogram is not judged.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(reference)
    schema = "id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, class_distance double, word_distance double, kept boolean"
    names = [x.split()[0] for x in schema.split(", ")]
    blank = [CLASSES.index("blank"), CLASSES.index("break")]

    def one(body: str | None, near: list):
        data = (body or "").encode()
        words = data.split()
        classes = class_counts(data)
        n, repeated = len(words), repeated_words(words)
        failed = n < rules.least_words or 100 * repeated > rules.most_repeated * n
        by_class = by_word = None
        if near and n >= rules.class_words:
            by_class = min(distance(classes, c) for c, _, _ in near)
        if near and n >= rules.word_words:
            bare = plain(data.lower().split())
            by_word = min(distance(np.bincount([at.get(w, len(at)) for w in bare], minlength=len(at) + 1), h) for _, at, h in near)
        kept = not failed and (by_class is None or by_class <= rules.class_distance) and (by_word is None or by_word <= rules.word_distance)
        return n, int(classes.sum() - classes[blank].sum()), int(classes[CLASSES.index("symbol")]), repeated_lines(data), repeated, failed, by_class, by_word, kept

    def judged(batch, nears):
        rows = [one(b, x) for b, x in zip(batch.column(1).to_pylist(), nears)]
        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.bool_()]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 9, kinds))], names=names)

    def run(batches):
        for batch in slices(batches):
            every = list(shipped.value.values())
            yield judged(batch, [[shipped.value[x]] if x in shipped.value else every for x in batch.column(2).to_pylist()])

    def run_small(batches):
        for batch in slices(batches):
            known: dict = {}
            nears = []
            for name, c, w, h in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5))):
                if c is not None and name not in known:
                    known[name] = (np.array(c, float), {x: i for i, x in enumerate(w)}, np.array(h, float))
                nears.append([known[name]] if c is not None else [])
            yield judged(batch, nears)

    rows = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    if small is None:
        return rows.mapInArrow(run, schema)
    other = F.col("lang").isNotNull() & (~F.col("lang").isin(list(reference)) if reference else F.lit(True))
    return rows.where(~other).mapInArrow(run, schema).unionByName(rows.where(other).join(small, "lang", "left").select("id", "text", "lang", "classes", "words", "histogram").mapInArrow(run_small, schema))


def judge_without_language(docs: DataFrame, reference: Reference, small: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rules: Rules = Rules(), block: int = LANGUAGES) -> DataFrame:
    """judge() of the rows without a language against every reference, those of small languages too, ``block`` at a time.

    The nearest reference counts, whichever pass meets it. There are as many passes as there are blocks of small languages.
    """
    numbered = docs.where(quoted(lang).isNull()).select(quoted(key).cast("bigint").alias("key"), quoted(text).alias("text"), quoted(lang).alias("lang"))
    rows = stored(numbered.withColumn("row", F.monotonically_increasing_id()), "unlabelled")
    blocks = -(-small.count() // block)
    passes = [judge(rows, reference, "row", "text", "lang", rules)]
    for i in range(blocks):
        some = small.where(F.pmod(F.xxhash64("lang"), F.lit(blocks)) == i).collect()  # about ``block`` languages
        passes.append(judge(rows, as_reference(some), "row", "text", "lang", rules))
    counters = [c for c in passes[0].columns if c not in ("id", "class_distance", "word_distance", "kept")]
    least = reduce(DataFrame.unionByName, passes).groupBy("id").agg(*(F.first(c).alias(c) for c in counters), *(F.min(c).alias(c) for c in ("class_distance", "word_distance")))
    near = lambda c, most: F.col(c).isNull() | (F.col(c) <= most)
    kept = ~F.col("base_failed") & near("class_distance", rules.class_distance) & near("word_distance", rules.word_distance)
    judged = least.withColumn("kept", kept).withColumnRenamed("id", "row").join(rows.select("row", F.col("key").alias("id")), "row")
    return judged.select(*passes[0].columns)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counters, divergences and verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    found = references(docs)
    large = large_ones(found)
    small = found.where(~F.col("lang").isin(list(large))) if large else found
    if small.isEmpty():
        return judge(docs, large).withColumnRenamed("id", "doc_id")
    known = judge(docs.where("lang IS NOT NULL"), large, small=small)
    return known.unionByName(judge_without_language(docs, large, small)).withColumnRenamed("id", "doc_id")
