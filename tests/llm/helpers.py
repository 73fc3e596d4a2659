"""Plain versions of the operators' contracts, for small tables."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")

AWKWARD = [
    (1, None, None, None), (2, "", "en", ""), (3, " \n\t ", "en", "s"), (4, "same text twice over", "en", "s"),
    (4, "same text twice over", "en", "s"), (5, "same text twice over", None, None),
    (None, "no id on this row at all", "fr", "s"), (6, "ß" * 9 + " ñandú 漢字 \U0001F600 end", "de", "t"),
    (7, "word " * 5000, "en", "s"), (8, "x" * 30_000, "en", "t"), (9, "1234 5678 !!", "en", "t"),
]


def words(text):
    return WORD.findall(text or "")


def documents(spark, rows=None, extra=True):
    """A documents table; with ``extra``, columns whose names clash with results."""
    rows = AWKWARD if rows is None else rows
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows],
                               "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        from pyspark.sql import functions as F

        for c in ("fp", "score", "n_words", "Kept", "spans", "taken", "block", "chunk", "component_id", "b", "t"):
            df = df.withColumn(c, F.lit("clash"))
    return df
