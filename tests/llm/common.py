"""Awkward documents that every operator must handle."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts):
    """texts: (doc_id, text) pairs."""
    return spark.createDataFrame([(i, t, "en", None, len(t) if t else None) for i, t in texts], SCHEMA)


def awkward(spark):
    long = " ".join(f"word{i % 997} filler{i}" for i in range(30_000))
    return documents(spark, [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "One two THREE four five six"), (6, long), (6, long), (7, "é ü ñ été 日本語   x"), (None, "no id at all"), (8, "one"), (9, "x" * 50_000)])
