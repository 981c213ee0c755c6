"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a target number of words. Complete epochs come first: every document is taken
as often as the whole source fits into its target. The rest is a weighted sample without replacement: documents
are ordered by exponential keys scaled by their quality weights, and a prefix sum of sizes
in that order is cut at the rest; the document that crosses it is taken in part.

The order within a source is never sorted as a whole. Sizes are summed in 1,024 ranges of keys, the range that
crosses the rest is split into 1,024 again until it has EDGE_ROWS rows or fewer, however keys are spread, and only these are
sorted, so that a source with a third of all rows is no burden to any task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberleaf.llm._skew import lookup
from emberleaf.llm._spark import stored
from emberleaf.llm._text import WORD

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2
#: Places in the order of keys, and ranges that a round splits, as powers of two.
PLACES, SPLIT = 50, 10
#: Rows of a source that are sorted.
EDGE_ROWS = 10_000
OWN = ("size", "source_size", "target", "epochs", "extra", "taken")


def quality(n_chars: Column, size: Column) -> Column:
    """A document's weight, at most 1: how near its mean word is to five letters and a space."""
    return F.when(size > 0, 1 / (1 + F.abs(n_chars / size - 6) / 6)).otherwise(1.0)


def keyed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` with ``size`` in words, the sampling key ``key_``, its place ``z_``, a long in the same order, and the source ``of_``, never null.

    The key depends on id and text alone, so reruns agree, and only rows alike in both tie.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    u = (F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), F.md5(body.cast("binary")))), 1, 13), 16, 10).cast("long") + 0.5) / float(2**52)
    out = docs.withColumn("size", F.regexp_count(body, F.lit(WORD)).cast("long"))
    out = out.withColumn("key_", -F.log(u) / quality(F.length(body), F.col("size")))
    place = F.floor(F.col("key_") / (1 + F.col("key_")) * float(1 << PLACES))
    return out.withColumn("z_", F.least(place, F.lit((1 << PLACES) - 1)).cast("long")).withColumn("of_", F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """Sources with ``source_size`` and ``target``.

    ``sizes`` has ``source`` and ``size``. Sources by code point, null last, take ``weights``
    in turn and share ``share`` times all sizes; a target stops at MOST times its source's size,
    and the excess goes to the others by weight until none is above. Sources of no words get 0.
    """
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rows = rows.withColumn("none_", F.col("source").isNull()).repartitionByRange("none_", "source").withColumn("slice_", F.spark_partition_id())
    rows = stored(rows)
    counts = rows.groupBy("slice_").count().orderBy("slice_").collect()  # a row for each partition
    base, offsets = 0, []
    for r in counts:
        offsets.append((r["slice_"], base))
        base += r["count"]
    if not base:
        return rows.select("source", "source_size", F.lit(0.0).alias("target"))
    start = F.coalesce(F.create_map(*(F.lit(x) for o in offsets for x in o))[F.col("slice_")], F.lit(0))
    turn = (start + F.row_number().over(W.partitionBy("slice_").orderBy("none_", "source")) - 1) % len(weights)
    rows = stored(rows.withColumn("weight_", F.element_at(F.array(*map(F.lit, map(float, weights))), (turn + 1).cast("int"))))
    level = None
    while True:
        capped = F.lit(False) if level is None else MOST * F.col("source_size") < level * F.col("weight_")
        got = rows.agg(F.sum("source_size").alias("all"), F.sum(F.when(capped, MOST * F.col("source_size")).otherwise(0)).alias("used"), F.sum(F.when(capped, 0.0).otherwise(F.col("weight_"))).alias("rest")).first()
        new = (share * got["all"] - got["used"]) / got["rest"] if got["rest"] else level
        if new == level:
            break
        level = new
    capped = MOST * F.col("source_size") < level * F.col("weight_")
    return rows.select("source", "source_size", F.when(capped, 1.0 * MOST * F.col("source_size")).otherwise(level * F.col("weight_")).alias("target"))


def cuts(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """``goals`` with complete ``epochs_`` and the places (from ``cut_`` below ``end_``, ``left_`` words of them) among which the fraction ends."""
    words = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.least(F.floor(words / F.col("source_size")), F.lit(MOST))).otherwise(0).cast("long")
    out = goals.withColumn("of_", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))).withColumn("epochs_", epochs)
    some = F.col("source_size") > 0
    out = out.select("of_", "source_size", "target", "epochs_", (words - F.col("epochs_") * F.col("source_size")).cast("long").alias("left_"), F.lit(0).cast("long").alias("cut_"), F.when(some, 1 << PLACES).otherwise(0).cast("long").alias("end_"), some.alias("open_"))
    out, width = stored(out), 1 << PLACES
    while not out.where("open_").isEmpty() and width > 1:
        width >>= SPLIT
        inside = (F.col("z_") >= F.col("cut_")) & (F.col("z_") < F.col("end_"))
        found = lookup(rows.where("size > 0"), out.where("open_").select("of_", "cut_", "end_"), ["of_"]).where(inside)
        found = found.groupBy("of_", F.floor((F.col("z_") - F.col("cut_")) / width).cast("long").alias("p_")).agg(F.sum("size").alias("n_"), F.count("*").alias("rows_"))
        found = found.withColumn("before_", F.sum("n_").over(W.partitionBy("of_").orderBy("p_")) - F.col("n_"))
        hit = (F.col("before_") <= F.col("left_")) & (F.col("left_") < F.col("before_") + F.col("n_"))
        found = found.join(out.select("of_", "left_"), "of_").where(hit).drop("left_", "n_")
        last = out.join(found, "of_", "left")
        low = F.col("cut_") + F.coalesce("p_", F.lit(0)) * width
        split = F.col("p_").isNotNull()
        out = stored(last.select("of_", "source_size", "target", "epochs_", (F.col("left_") - F.coalesce("before_", F.lit(0))).alias("left_"), low.alias("cut_"), F.when(split, low + width).otherwise(F.col("end_")).alias("end_"), (split & (F.col("rows_") > EDGE_ROWS)).alias("open_")))
    return out


def taken(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """``rows`` with ``source_size``, ``target``, complete ``epochs``, words of a further part ``extra`` and all ``taken``."""
    both = lookup(rows, ends.drop("open_"), ["of_"])
    inside = (F.col("z_") >= F.col("cut_")) & (F.col("z_") < F.col("end_")) & (F.col("size") > 0)
    plain = both.where(~inside).withColumn("extra", F.when(F.col("z_") < F.col("cut_"), F.col("size")).otherwise(0).cast("long"))
    order = W.partitionBy("of_").orderBy("key_", F.col("size").desc())
    edge = both.where(inside).withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("left_") - (F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")))).cast("long"))
    out = plain.unionByName(edge).withColumn("epochs", F.col("epochs_")).withColumn("taken", F.col("epochs_") * F.col("size") + F.col("extra"))
    return out.drop("of_", "epochs_", "cut_", "end_", "left_", "key_", "z_")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS, share: float = SHARE, texts: bool = True) -> DataFrame:
    """``docs`` with the columns of ``taken``; without ``texts`` the text column is left out.

    A null text has size 0, a null source is a source, a null id an id. Repeated rows are
    samples of their own: they tie and are interchangeable, and ties within the last range are sorted together. A very
    long document may be cut by its source's budget. An empty table gives no rows. A column of a result's name is replaced.
    Texts are read once; what is measured of them is stored.
    """
    rows = keyed(docs.drop(*(c for c in (*OWN, "key_", "z_", "of_") if c not in (key, text, source))), key, text, source)
    rows = stored(rows if texts else rows.drop(text))
    slim = rows.select(F.col(source).alias("source"), "of_", "size", "z_")
    return taken(rows, cuts(slim.drop("source"), targets(slim.select("source", "size"), weights, share)))


def copies(mixed: DataFrame, text: str = "text") -> DataFrame:
    """A row for each time that a document is taken, a part of it with just its first ``extra`` words."""
    part = F.array_join(F.slice(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0)), 1, F.greatest(F.col("extra"), F.lit(1)).cast("int")), " ")
    whole = F.array_repeat(F.col(text), F.col("epochs").cast("int"))
    more = F.when(F.col("extra") == F.col("size"), F.array(F.col(text))).otherwise(F.array(part))
    texts = F.when(F.col("size") == 0, F.array().cast("array<string>")).when(F.col("extra") > 0, F.concat(whole, more)).otherwise(whole)
    return mixed.withColumn("copy_", F.explode(texts)).withColumn(text, F.col("copy_")).drop("copy_")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, coalesce(length(text), 0) AS n_chars,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS h
  FROM documents),
k AS (
  SELECT doc_id, source, size,
         -ln((CAST('0x' || substr(h, 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)
         / CASE WHEN size > 0 THEN 1 / (1 + abs(CAST(n_chars AS DOUBLE) / size - 6) / 6) ELSE 1.0 END AS sort_key
  FROM d),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE row_number() OVER (ORDER BY source NULLS LAST) % 3 WHEN 1 THEN 5.0::DOUBLE WHEN 2 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM k GROUP BY source),
l AS (
  SELECT *, 2 * source_size / weight AS ratio,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s),
m AS (SELECT min(level) AS level FROM (SELECT level FROM l WHERE level <= ratio ORDER BY ratio LIMIT 1)),
t AS (
  SELECT source, source_size, CASE WHEN 2 * source_size < m.level * weight THEN CAST(2 * source_size AS DOUBLE) ELSE m.level * weight END AS target
  FROM s, m),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target) AS BIGINT) // source_size, 2) ELSE 0 END AS epochs FROM t),
p AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, floor(e.target) - e.epochs * e.source_size AS rest,
         sum(k.size) OVER (PARTITION BY k.source ORDER BY k.sort_key, k.size DESC ROWS UNBOUNDED PRECEDING) - k.size AS before
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken
FROM p
"""
