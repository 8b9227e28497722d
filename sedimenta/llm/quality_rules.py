"""Quality rules: text statistics, and lines that many documents of a host share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, words, written

SYMBOL = "[#*$%&|<>]"
#: Rows that a frequent line of a host is repeated over at least, so that its documents meet it in as many tasks, and documents for which there is one more.
SALTS, SALT_DOCS = 16, 1 << 16


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of the whole text, and lines; null counts as empty.

    lines holds (h, n) of each line with a word: the hash of its normal form (lower case, words one space apart) and its
    number of words. Repeats are found by sorting a text's 3-word windows, not by comparing them with each other.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    docs = docs.withColumn("_lines", F.filter(F.split(value, "\n"), lambda x: x.rlike(WORD)))
    docs = docs.withColumn("_each", F.transform("_lines", words)).withColumn("_words", F.flatten("_each"))
    n = F.size("_words")
    window = lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2))
    docs = docs.withColumn("_w3", F.when(n > 2, F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), window)).otherwise(F.array().cast("array<bigint>")))
    some = F.size(F.array_distinct("_w3")) < F.size("_w3")
    docs = docs.withColumn("_sorted", F.when(some, F.sort_array(F.transform("_w3", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    again = lambda x, j: F.coalesce(x.h == F.get("_sorted", j - 1).h, F.lit(False)) | F.coalesce(x.h == F.get("_sorted", j + 1).h, F.lit(False))
    docs = docs.withColumn("_at", F.when(F.col("_sorted").isNotNull(), F.sort_array(F.transform(F.filter("_sorted", again), lambda x: x.i))))
    covers = F.transform("_at", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("_at", j + 1) - p, F.lit(3))))
    return docs.select(
        *[c for c in docs.columns if c not in ("_lines", "_each", "_words", "_w3", "_sorted", "_at")],
        n.cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count(value, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(covers, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.transform("_each", lambda w: F.struct(F.xxhash64(F.lower(F.array_join(w, " "))).alias("h"), F.size(w).alias("n"))).alias("lines"),
    )


def frequent_lines(rows: DataFrame, limit: int = 20) -> DataFrame:
    """(host, line, n_docs): hashes of the lines that more than `limit` of rows(host, lines) of a host have.

    A text's own repeats are taken out before anything is shuffled, and counts are summed map-side.
    """
    each = rows.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x.h))).alias("line"))
    return each.groupBy("host", "line").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > limit)


def line_frequency(docs: DataFrame, limit: int = 20, depleted: float = 0.5) -> DataFrame:
    """For each row of docs(doc_id, source, text): its statistics, n_removed_lines, n_left_words, base_failed, kept, removed_lines.

    A line is removed if its normalised form stands in more than `limit` documents of the document's host (its
    source). A document is depleted, and rejected, if less than `depleted` of its words are left. removed_lines holds
    the places of the removed ones among the lines that have words; cleaned() applies it. Lines of a frequent hash are
    found by a join whose frequent side is repeated over SALTS keys, more if the most frequent line needs them, so a line of a third of all documents is dealt out. Texts are
    read once; what is compared is written.

    Each row counts as a document, equal rows too, and they get equal results. Null text is an empty text, a null
    source a host of its own; a null doc_id is allowed. A text without words fails. An empty table gives no rows.
    Other columns are ignored, whatever their names.
    """
    rows = docs.select("doc_id", F.coalesce("source", F.lit("\0null")).alias("host"), F.monotonically_increasing_id().alias("rid"), "text")
    rows = written(with_statistics(rows).drop("text"))
    frequent = written(frequent_lines(rows, limit))
    salts = max(SALTS, (frequent.agg(F.max("n_docs")).first()[0] or 0) // SALT_DOCS)
    frequent = frequent.select("host", "line", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    each = rows.select("rid", "host", F.posexplode("lines")).select("rid", "host", "pos", F.col("col.h").alias("line"), F.col("col.n").alias("n"))
    each = each.withColumn("salt", F.pmod(F.hash("rid", "pos"), F.lit(salts)))
    gone = each.join(frequent, ["host", "line", "salt"], "left_semi").groupBy("rid").agg(F.collect_list("pos").alias("_at"), F.sum("n").alias("_gone"))
    out = rows.drop("lines").join(gone, "rid", "left")
    removed = F.sort_array(F.coalesce("_at", F.array().cast("array<int>")))
    left = F.col("n_words") - F.coalesce("_gone", F.lit(0))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.size(removed).cast("long").alias("n_removed_lines"), left.cast("long").alias("n_left_words"), failed.alias("base_failed"),
        (~failed & (left >= depleted * F.col("n_words"))).alias("kept"), removed.alias("removed_lines"),
    )


def cleaned(text: Column, removed: Column) -> Column:
    """A text without the removed ones among its lines that have words; lines without words go too."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(WORD))
    return F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(removed, i)), "\n")


_W = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"
QUERY_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(source, chr(1) || 'null') AS host, coalesce(text, '') AS text,
                  row_number() OVER () AS rid FROM documents),
w AS (SELECT rid, {_W.format('text')} AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
g AS (SELECT rid, unnest(range(1, len(ws) - 1)) AS i, ws FROM w),
g3 AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i], ws[i + 1], ws[i + 2]) AS c FROM g),
rep AS (SELECT rid, count(DISTINCT i + j) AS n_repeat FROM (SELECT rid, i, unnest([0, 1, 2]) AS j FROM g3 WHERE c > 1) GROUP BY rid),
l AS (SELECT d.rid, d.host, unnest(ls) AS line FROM w JOIN d USING (rid)),
n AS (SELECT rid, host, lower(array_to_string({_W.format('line')}, ' ')) AS line, len({_W.format('line')}) AS nw FROM l),
f AS (SELECT host, line FROM n GROUP BY host, line HAVING count(DISTINCT rid) > 20),
gone AS (SELECT rid, count(*) AS nl, sum(nw) AS nw FROM n SEMI JOIN f USING (host, line) GROUP BY rid),
s AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(text, '{SYMBOL}')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(nl, 0) AS BIGINT) AS n_removed_lines,
        CAST(len(ws) - coalesce(nw, 0) AS BIGINT) AS n_left_words
      FROM d JOIN w USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN gone USING (rid))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_left_words >= 0.5 * n_words AS kept
FROM s
"""
