"""Small tables with the awkward cases every operator has to stand."""

from __future__ import annotations

LONG = " ".join(f"word{i % 997}" for i in range(30_000))

#: Null and empty texts, null keys, repeated rows, equal texts, odd characters, a long text.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog, again and again."),
    (2, "The quick brown fox jumps over the lazy dog, again and again."),
    (2, "The quick brown fox jumps over the lazy dog, again and again."),
    (3, None),
    (4, ""),
    (None, "No key but some words."),
    (None, None),
    (5, " \n\t "),
    (6, "ÉTÉ ﬁ 日本語 🙂 \x00 é İstanbul ＡＢ"),
    (7, LONG),
    (8, "x" * 20_000),
    (9, "<s> </s> <|endoftext|> <unk> &amp; <b>"),
    (10, "one"),
]

COLUMNS = "doc_id long, text string"


def documents(spark, rows=None, extra=True):
    """The rows as a table; with columns whose names operators use inside."""
    df = spark.createDataFrame(ROWS if rows is None else rows, COLUMNS)
    if extra:
        for name in ("key", "row", "node", "n", "bucket", "stats", "label", "score", "own"):
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit("clash"))
    return df
