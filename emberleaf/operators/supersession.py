"""Topic supersession: which artifact a newer one of the same topic replaces, and what that does to search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberleaf.sources.tables import checkpointed, stored

LEAST, PENALTY, BOOST = 0.70, 0.3, 1.2


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


#: Days with a set of terms that a kind may have for each to be compared with every older one.
FEW = 200


def register(rows: DataFrame, least: float = LEAST) -> DataFrame:
    """``new_id`` and the ``old_id`` that it supersedes.

    ``rows`` has ``id``, ``kind``, ``terms`` and ``created_date``. Both must be of one kind, have two terms or more and
    share ``least`` of them; the old one is strictly older. The best match wins, then the later date, then the smaller id.

    Terms are few and dates are days, so artifacts are first one row for each distinct set of terms and day. Those of a kind of
    up to FEW are compared with all older ones of the kind, where they lie after one shuffle; those of larger kinds by ``_of_large_kinds``.
    """
    known = rows.where(F.col("kind").isNotNull()).select("id", "kind", "created_date", F.array_sort(F.array_distinct("terms")).alias("terms")).where(F.size("terms") >= 2)
    known = stored(known.where("created_date is not null"))
    days = stored(known.groupBy("kind", "terms", "created_date").agg(F.min("id").alias("id")))
    large = stored(days.groupBy("kind").agg(F.count("*").alias("n")).where(F.col("n") > FEW).select("kind"))
    some = not large.isEmpty()
    small = days.join(large, "kind", "left_anti") if some else days
    side = lambda s: small.select("kind", *(F.col(c).alias(f"{s}_{c}") for c in ("terms", "created_date", "id")))
    n, o = F.size("new_terms"), F.size("old_terms")
    fits = (F.col("old_created_date") < F.col("new_created_date")) & (F.least(n, o) >= least * F.greatest(n, o) - 1e-9)
    pairs = side("new").join(side("old").hint("merge"), "kind").where(fits).withColumn("similarity", jaccard(F.col("new_terms"), F.col("old_terms"))).where(F.col("similarity") >= least)
    best = W.partitionBy("kind", "new_terms", "new_created_date").orderBy(F.desc("similarity"), F.desc("old_created_date"), "old_id")
    last = pairs.withColumn("r", F.row_number().over(best)).where("r = 1")
    last = last.select("kind", F.col("new_terms").alias("terms"), F.col("new_created_date").alias("created_date"), "similarity", "old_id")
    if some:
        last = last.unionByName(_of_large_kinds(days.join(large, "kind", "left_semi"), least))
    found = known.join(last, ["kind", "terms", "created_date"])
    return found.select(F.col("id").alias("new_id"), "old_id", "similarity", F.col("created_date").alias("new_date"))


def _of_large_kinds(days: DataFrame, least: float) -> DataFrame:
    """The best older match of each of ``days``, a row for each ``kind``, ``terms`` and ``created_date`` with the smallest ``id``.

    Sets are matched by a term of a prefix: two sets of this similarity share one of the first
    ``n - ceil(least * n) + 1`` terms in an order from rare to frequent. For each set and day the best similarity that has
    an older day is picked, and within it the last such day. The work grows with sets and days, not with pairs of artifacts.
    """
    days = stored(days.withColumn("topic", F.md5(F.to_json(F.struct("kind", "terms")))))
    sets = days.groupBy("topic").agg(F.first("kind").alias("kind"), F.first("terms").alias("terms"), F.min("created_date").alias("since"), F.max("created_date").alias("until"))
    words = stored(sets.select("topic", "kind", "terms", "since", "until", F.size("terms").alias("n"), F.explode("terms").alias("term")))
    df = words.groupBy("kind", "term").agg(F.count("*").alias("df"))
    order = W.partitionBy("topic").orderBy("df", "term")
    cut = F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1
    prefix = words.join(df, ["kind", "term"]).withColumn("r", F.row_number().over(order)).where(F.col("r") <= cut)
    side = lambda s: prefix.select("kind", "term", *(F.col(c).alias(f"{s}_{c}") for c in ("topic", "n", "terms", "since", "until")))
    fits = (F.col("old_since") < F.col("new_until")) & (F.least("new_n", "old_n") >= least * F.greatest("new_n", "old_n") - 1e-9)
    pairs = side("new").join(side("old"), ["kind", "term"]).where(fits).dropDuplicates(["new_topic", "old_topic"])
    pairs = pairs.withColumn("similarity", jaccard(F.col("new_terms"), F.col("old_terms"))).where(F.col("similarity") >= least)
    pairs = stored(pairs.select("new_topic", "old_topic", "similarity", F.col("old_since").alias("since")))

    # the best similarity of each set and day with an older artifact
    levels = pairs.groupBy("new_topic", "similarity").agg(F.min("since").alias("since")).groupBy("new_topic").agg(F.sort_array(F.collect_list(F.struct("similarity", "since")), asc=False).alias("levels"))
    asked = days.select(F.col("topic").alias("new_topic"), F.col("created_date").alias("day")).join(levels, "new_topic")
    best = F.get(F.filter("levels", lambda x: x["since"] < F.col("day")), F.lit(0))["similarity"]
    asked = asked.select("new_topic", "day", best.alias("similarity")).where("similarity is not null")
    # of each matching set its last day before that one
    asked = asked.join(pairs.select("new_topic", "old_topic", "similarity"), ["new_topic", "similarity"])
    points = days.select(F.col("topic").alias("old_topic"), F.col("created_date").alias("day"), F.struct(F.col("created_date").alias("old_date"), F.col("id").alias("old_id")).alias("old"), F.lit(None).cast("string").alias("new_topic"), F.lit(None).cast("double").alias("similarity"))
    both = points.unionByName(asked.withColumn("old", F.lit(None).cast(points.schema["old"].dataType)).select(points.columns))
    # at one day questions come before the answer of that day
    before = W.partitionBy("old_topic").orderBy("day", F.col("old").isNotNull()).rowsBetween(W.unboundedPreceding, -1)
    hit = both.withColumn("old", F.last("old", ignorenulls=True).over(before)).where("new_topic is not null and old is not null")
    newest = W.partitionBy("new_topic", "day").orderBy(F.desc("old.old_date"), "old.old_id")
    last = hit.withColumn("r", F.row_number().over(newest)).where("r = 1")
    last = last.select(F.col("new_topic").alias("topic"), F.col("day").alias("created_date"), "similarity", "old.old_id")
    return days.select("topic", "kind", "terms", "created_date").join(last, ["topic", "created_date"]).select("kind", "terms", "created_date", "similarity", "old_id")


def superseded_by(found: DataFrame) -> DataFrame:
    """``id`` and the first newer artifact ``by`` that superseded it."""
    first = F.min(F.struct("new_date", "new_id")).alias("f")
    return found.groupBy(F.col("old_id").alias("id")).agg(first).select("id", F.col("f.new_id").alias("by"))


def chain_ends(links: DataFrame, rounds: int = 40) -> DataFrame:
    """``id`` and the end of its chain of ``by``.

    Pointers double each round, so a chain of any length up to 2^rounds takes its logarithm.
    """
    checkpointed(links)
    at = stored(links.select("id", F.col("by").alias("end")))
    for _ in range(rounds):
        nxt = at.select(F.col("id").alias("end"), F.col("end").alias("further"))
        at = at.join(nxt, "end", "left").select("id", F.coalesce("further", "end").alias("end"), F.col("further").isNotNull().alias("moved")).checkpoint()
        if at.where("moved").isEmpty():
            break
        at = at.drop("moved")
    return at.select("id", "end")


def adjust(results: DataFrame, links: DataFrame, ends: DataFrame, hide: bool = True) -> DataFrame:
    """Search ``results`` (``id``, ``score``) after supersession, with ``superseded``.

    A superseded one is dropped if ``hide`` and the end of its chain is also found, else it keeps 0.3 of its
    score; one that supersedes others gains a fifth.
    """
    found = results.select(F.col("id").alias("end"), F.lit(True).alias("end_found"))
    marked = results.join(ends, "id", "left").join(found, "end", "left")
    newer = links.select(F.col("by").alias("id")).distinct().withColumn("newer", F.lit(True))
    out = marked.join(newer, "id", "left").withColumn("superseded", F.col("end").isNotNull())
    if hide:
        out = out.where(~(F.col("superseded") & F.coalesce("end_found", F.lit(False)) & (F.col("end") != F.col("id"))))
    score = F.when(F.col("superseded"), F.col("score") * PENALTY).when(F.col("newer"), F.col("score") * BOOST).otherwise(F.col("score"))
    return out.select("id", score.alias("score"), "superseded").orderBy(F.desc("score"), "id")
