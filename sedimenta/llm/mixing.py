"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, scratch, written

#: Expected copies are counted in units of 2**-24, so that sums of them are exact.
UNIT = 1 << 24
#: Hash classes that a size class of a source is dealt over at least, and rows for which there is one more.
SALTS, SALT_ROWS = 64, 1 << 20


def _ranked(per: DataFrame) -> DataFrame:
    """per(source, ...) with n, the place of each source by code point, null last: places in ranges, and a sum for each range."""
    dealt = written(per.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_p", F.spark_partition_id()))
    many = dealt.groupBy("_p").agg(F.count("*").alias("_m"))  # a row for each partition
    before = many.select("_p", (F.sum("_m").over(Window.orderBy("_p")) - F.col("_m")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_p").orderBy(F.col("source").asc_nulls_last()))
    return dealt.withColumn("_i", place).join(F.broadcast(before), "_p").withColumn("n", F.col("_before") + F.col("_i") - 1).drop("_p", "_i", "_before")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, size).

    Sources in order of their code points, null last, weigh `weights`, repeating, and share the total of all sizes. A
    target stops at `most` times its source's size; the excess goes to the others by weight until none is above. Each
    round of sharing is one aggregation over the sources; a source that is above its limit stays there, so rounds end.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    weigh = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("n") % len(weights) + 1).cast("int")).cast("long")
    ranked = written(_ranked(per).select("source", "source_size", weigh.alias("w"), (F.col("source_size") * most).alias("cap")))
    sums = ranked.agg(F.sum("source_size").alias("total"), F.sum("w").alias("w")).first()
    total, open_weight, capped, level = sums.total or 0, sums.w or 0, -1, 0.0
    while open_weight:
        level = (total - max(capped, 0)) / open_weight
        above = F.col("cap") <= F.lit(level) * F.col("w")
        got = ranked.agg(F.sum(F.when(above, F.col("cap")).otherwise(0)).alias("cap"), F.sum(F.when(above, 0).otherwise(F.col("w"))).alias("w")).first()
        if (got.cap, got.w) == (capped, open_weight):
            break
        capped, open_weight = got.cap, got.w
    share = F.lit(level) * F.col("w")
    return ranked.select("source", "source_size", F.when(F.lit(not open_weight) | (share >= F.col("cap")), F.col("cap").cast("double")).otherwise(share).alias("target"))


def systematic_mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 7, whole_rows: bool = False) -> DataFrame:
    """For each row of docs(doc_id, source, text): doc_id, size, source_size, target, copies, taken; with whole_rows also the row.

    A document is expected target / source_size times, at most `most`. The documents of a source stand in order of
    size class and of a hash of their doc_id and text; their expected copies are summed from one random offset, which
    depends on seed and source alone, and a document is emitted once for each integer that the sum crosses on it. Sums are
    exact integers. They are taken in three steps (over a source's size classes, a class's hash classes, and within
    one of these), so a hot source or size is spread over many tasks, more with more rows. Texts aren't sorted or summed over: the sample is
    drawn from sizes and joined to the rows last.

    Null text has size 0; a null source is a source of its own, a null doc_id a document like any other. Equal rows
    are each a document; which of them gets an odd copy doesn't show. A source without words is taken 0 times and has
    target 0. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce("text", F.lit("")))))
    whole = [F.struct(*docs.columns).alias("row"), F.monotonically_increasing_id().alias("rid")] if whole_rows else []
    with scratch(docs.sparkSession) as kept:
        rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), key.alias("_key"), *whole)
        rows = rows.withColumn("_class", F.when(F.col("size") > 0, F.floor(F.log2("size") * 8).cast("int")).otherwise(-1))
        rows = written(rows.withColumn("_source", F.coalesce("source", F.lit("\0null"))))
        kept.append(rows)
        salts = max(SALTS, rows.count() // SALT_ROWS)
        slim = rows.drop("row", "source").withColumn("_salt", (F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") % salts).cast("int"))
        wanted = targets(rows.select("source", "size"), weights, most).select(
            F.coalesce("source", F.lit("\0null")).alias("_source"), "source_size", "target",
            F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") * UNIT)).otherwise(0).cast("long").alias("_rate"),
        )
        salt: Column = F.when(F.col("_source") == "\0null", "null").otherwise(F.col("_source"))
        offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), salt)), 1, 6), 16, 10).cast("long")
        cells = written(slim.groupBy("_source", "_class", "_salt").agg(F.count("*").alias("_n")))
        first = lambda *by: F.coalesce(F.sum("_n").over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        classes = cells.groupBy("_source", "_class").agg(F.sum("_n").alias("_n")).select("_source", "_class", first("_source", "_class").alias("_before_class"))
        cells = cells.withColumn("_before", first("_source", "_class", "_salt")).join(classes, ["_source", "_class"]).join(wanted, "_source")
        cells = written(cells.select("_source", "_class", "_salt", (F.col("_before") + F.col("_before_class")).alias("_before"), "source_size", "target", "_rate", offset.alias("_offset")))
        kept.append(cells)
    cell = ["_source", "_class", "_salt"]
    within = Window.partitionBy(*cell).orderBy("_key")
    crossed = F.expr(f"(_offset + (_before + _i) * _rate) div {UNIT} - (_offset + (_before + _i - 1) * _rate) div {UNIT}")
    placed = slim.withColumn("_i", F.row_number().over(within)).join(cells, cell).withColumn("copies", crossed.cast("long"))
    out = placed.select(*(["rid"] if whole_rows else []), "doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    return out.join(rows.select("rid", "row"), "rid").drop("rid") if whole_rows else out


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs themselves, each as often as systematic_mix() takes it."""
    taken = systematic_mix(docs, whole_rows=True, **options).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


QUERY_SQL = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w, 3 * source_size AS cap,
             row_number() OVER (ORDER BY source NULLS LAST) AS n FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::DOUBLE AS lev
      FROM r WINDOW b AS (ORDER BY cap / w::DOUBLE, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, w, cap, max(CASE WHEN lev * w <= cap THEN lev END) OVER () AS lvl FROM l),
g AS (SELECT source, source_size, CASE WHEN lvl IS NULL OR lvl * w >= cap THEN CAST(cap AS DOUBLE) ELSE lvl * w END AS target FROM t),
x AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size * {UNIT}) AS BIGINT) ELSE 0 END AS rate,
             CAST('0x' || substr(md5('7:' || coalesce(source, 'null')), 1, 6) AS BIGINT) AS off FROM g),
o AS (SELECT d.doc_id, d.size, x.source, x.source_size, x.target, x.rate, x.off,
             row_number() OVER (PARTITION BY d.source ORDER BY CASE WHEN d.size > 0 THEN CAST(floor(log2(d.size) * 8) AS INT) ELSE -1 END,
                                CAST('0x' || substr(h, 1, 8) AS BIGINT) % {SALTS}, h) AS i
      FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source)
SELECT doc_id, size, source_size, target, CAST((off + i * rate) // {UNIT} - (off + (i - 1) * rate) // {UNIT} AS BIGINT) AS copies,
       CAST(size * ((off + i * rate) // {UNIT} - (off + (i - 1) * rate) // {UNIT}) AS BIGINT) AS taken
FROM o
"""
