"""Small tables with everything that real ones have: nulls, empties, ties, repeats, very long texts, clashing names."""

import random

DOCS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
CLASHES = ["row", "key", "digest", "node", "fingerprint", "component", "score", "label", "line", "n", "place", "item", "weight", "leaf", "template", "path", "part", "rank", "host", "drops"]

rng = random.Random(5)
SYLLABLES = "an be co du en fi go ha in jo ka lu me no or pa qu re so ti un vo we".split()


def words(n, seed=None):
    own = random.Random(seed) if seed is not None else rng
    return ["".join(own.choice(SYLLABLES) for _ in range(own.randint(2, 4))) for _ in range(n)]


def prose(n, seed=None):
    return " ".join(words(n, seed))


def documents():
    a, b = prose(80, 1), prose(60, 2).split()
    near = [*b[:30], "changed", *b[31:]]
    return [
        (1, a, "en", "s", len(a)),
        (2, a, "en", "s", len(a)),
        (3, " ".join(b), "en", "s", 1),
        (4, " ".join(near), "en", None, None),
        (5, None, None, "s", None),
        (6, "", "en", "s", 0),
        (7, " \t\n ", "en", "s", 4),
        (8, "one two", "en", "s", 7),
        (8, "one two", "en", "s", 7),
        (None, "a text without an id " + prose(20, 3), "en", "s", None),
        (None, None, None, None, None),
        (9, prose(30_000, 4), "de", "s", 1),
        (10, "x" * 300_000, "de", "s", 1),
        (11, "Ünïcödé — ▁ ß \x00 \u2028 日本語 🙂 <|endoftext|> <s> 1.5e3", "xx", "t", 1),
        (12, prose(40, 6) + "\nAll rights reserved.", "en", "t", 1),
    ]


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def clashing(docs, but=()):
    """The same rows with more columns, named like an operator's own."""
    from pyspark.sql import functions as F

    taken = {c.lower() for c in docs.columns} | set(but)
    return docs.select("*", *[F.lit(f"extra {c}").alias(c) for c in CLASHES if c not in taken])


def rows_of(df):
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))
