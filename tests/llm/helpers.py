"""Small inputs that every operator must survive, and the driver's small documents as plain rows."""

import duckdb

SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, kept boolean, quality string, id long"


def rows_of(sf=SF001):
    return duckdb.sql(f"select doc_id, text, lang, source from '{sf}/documents.parquet' order by doc_id").fetchall()


def odd_rows():
    """Nulls in every column, empty, blank and long texts, repeated rows, ties of an id, other alphabets."""
    words = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    texts = [(1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, "a"), (4, words, "de", None), (5, words, "de", "b"),
             (6, "one", "fr", "b"), (7, "one two", "fr", None), (8, "Ünïcode ✓ 漢字 text here", None, "c"), (8, "Ünïcode ✓ 漢字 text here", None, "c"),
             (9, "tie first " * 30, "en", "c"), (9, "tie second " * 30, "en", "c"), (None, "no id at all", "en", "a"), (10, "a" * 5000, "en", "a"),
             (11, "\n \n  x   y\r\n\tz  ", "en", "a"), (12, words[:400], "en", "a"), (13, words[:400], "en", "a")]
    return [(i, t, lang, s, None, "x", None, "y", 3) for i, t, lang, s in texts]


def frame(spark, rows=None):
    return spark.createDataFrame(odd_rows() if rows is None else [(i, t, lang, s, None, "x", None, "y", 3) for i, t, lang, s in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
