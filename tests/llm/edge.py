"""Small tables with every awkward case: nulls in any column, empty and very long texts, ties, repeated rows, extra columns
of clashing names, and no rows at all."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, row int, n double, score string, kept string, slot string, fp string, digest int, word string"


def random_text(rng: random.Random, words: int, alphabet: str = "abcdeé") -> str:
    return " ".join("".join(rng.choices(alphabet, k=rng.randint(1, 7))) for _ in range(words))


def documents(spark, empty: bool = False):
    rng = random.Random(4)
    long = random_text(rng, 60_000)
    texts = [
        (None, "a text without a key", "en", "s"), (1, None, None, None), (2, "", "en", "s"), (3, " \n\t\r\x0b\x0c", "de", None), (4, long, "en", "s"), (5, long + " end", "en", "t"),
        (6, "Same text here, twice.", "en", "s"), (7, "Same  text\there,\ntwice.", "fr", "t"), (8, "same text here, twice.", "fr", "t"), (6, "Same text here, twice.", "en", "s"),
        (9, "12345 67890 !!!", "en", "s"), (10, "日本語 のテキスト 🙂🙂 x", "ja", "u"), (11, "one", "en", "s"), (12, "one two", "en", "s"), (-13, "<|endoftext|> 's 're'll  x", None, "s"),
        (14, "line\nline\nother\nline", "en", None), (15, None, "en", "s"), (16, "a" * 5000, "de", "s"),
    ]
    texts += [(20 + i, random_text(rng, rng.randint(20, 80), "abcdefgh" if i % 2 else "stuvwxyé"), "en" if i % 2 else "fr", f"s{i % 3}") for i in range(60)]
    rows = [] if empty else [(d, t, x, s, None, "id", 1, None, "s", "k", "slot", None, 2, "w") for d, t, x, s in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3) if rows else spark.createDataFrame([], SCHEMA)


def pages(spark, empty: bool = False):
    schema = "page_id long, url string, html string, id string, digest string, offset int"
    body = "<p>" + "x" * 120 + "</p>"
    rows = [
        (3, "http://a.example.com/x?q=1", body), (1, "https://b.example.com:8080/", body), (2, None, body), (4, "not an address", "short"), (5, "http://a.example.com/x?q=1", "short"), (6, "", None), (7, "http://[broken", ""),
        (None, "http://c.example.org/", body), (8, "http://ünï.example/ö ä", "é🙂" * 200), (9, "http://z.example/", "y" * 300_000), (1, "https://b.example.com:8080/", body),
    ]
    data = [] if empty else [(*r, "i", "d", 1) for r in rows]
    return spark.createDataFrame(data, schema).repartition(3) if data else spark.createDataFrame([], schema)
