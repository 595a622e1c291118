"""Fixtures of the training-data tests: awkward documents and small tables."""

import random

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, n string, key string"


def doc_rows(texts, langs=None, start=1):
    """Rows with extra columns whose names clash with the operators' own."""
    langs = langs or ["en"] * len(texts)
    return [(start + i, t, x, f"s{i % 2}", None if t is None else len(t), -i, "x", "y")
            for i, (t, x) in enumerate(zip(texts, langs))]


def docs_frame(spark, texts, langs=None, start=1):
    from churnlake.llm.common import _importable
    _importable(spark)
    return spark.createDataFrame(doc_rows(texts, langs, start), DOC_SCHEMA)


def awkward():
    """Null, empty, blank, one word, repeated, very long, unusual characters."""
    r = random.Random(5)
    long = " ".join(r.choice(["alpha", "beta", "gamma", "delta"]) + str(r.randrange(900)) for _ in range(20_000))
    return [None, "", " \t\n ", "word", "word", "Two words", "a b \x1f c", "naïve café 世界 😀", "x" * 50_000, long,
            long + " end", "the cat sat\n" * 40]
