"""Tables with what real ones hold: nulls, empty and long texts, ties, repeated rows, and columns named as results are."""

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean, n_words long, row string, fp string, rid long"


def table(spark, rows, schema="doc_id long, text string, source string, lang string, n_chars long"):
    return spark.createDataFrame(rows, schema)


def odd_documents(spark, long_words=30_000):
    """Rows (doc_id, text, lang, source, ...) with an extra column for each name that operators use themselves."""
    prose = "one two three four five six seven eight nine ten " * 8
    rows = [
        (1, prose, "en", "a"), (1, prose, "en", "a"), (2, prose, None, None), (3, None, "en", "a"), (4, "", "de", "b"), (5, " \t\n\x0b\x0c\r ", "de", "b"),
        (None, "a null id", "en", "c"), (None, None, None, None), (6, " ".join(f"w{i}" for i in range(long_words)), "en", "c"), (7, "x" * 100_000, "fr", "c"),
        (8, "wörter mit Ünïcode 🙂🙂 und mehr", "de", ""), (9, "\n\n\n", "de", ""), (10, prose + "end", "en", "a"), (11, "tie", "en", "b"), (12, "tie", "en", "b"),
    ]
    return spark.createDataFrame([(*r, 7, 99, False, -1, "r", "f", 5) for r in rows], DOCS)


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=repr)
