"""Storage tiers: candidates, cascades, statistics, compaction and rollup.

Times are seconds since the epoch; the present is an argument of every operator.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hours of age and of rest after which an artifact leaves each tier, and least bytes of one that leaves ``hot``.
THRESHOLDS = {"warm": (168, 72), "cold": (720, 336), "frozen": (2160, 720)}
MIN_BYTES = 512
BEFORE = {"warm": "hot", "cold": "warm", "frozen": "cold"}


def hours_since(t: Column, now: float) -> Column:
    return (F.lit(float(now)) - t) / 3600


def by_tier(registry: DataFrame, tier: str) -> DataFrame:
    return registry.where(F.col("tier") == tier)


def due(tier: str, now: float, thresholds: Mapping = THRESHOLDS, min_bytes: int = MIN_BYTES) -> Column:
    """Whether an artifact of the tier before has the age and rest to move to ``tier``."""
    age, idle = thresholds[tier]
    ok = (hours_since(F.col("created_at"), now) >= age) & (hours_since(F.col("last_accessed"), now) >= idle)
    return ok & (F.col("original_size") >= min_bytes) if tier == "warm" else ok


def candidates(registry: DataFrame, tier: str, now: float, thresholds: Mapping = THRESHOLDS) -> DataFrame:
    return by_tier(registry, BEFORE[tier]).where(due(tier, now, thresholds))


def cascade(registry: DataFrame, now: float, thresholds: Mapping = THRESHOLDS) -> DataFrame:
    """``registry`` with ``new_tier``: phases warm, cold and frozen of one run, each after the one before."""
    new = F.col("tier")
    for tier in thresholds:
        new = F.when((new == BEFORE[tier]) & due(tier, now, thresholds), tier).otherwise(new)
    return registry.withColumn("new_tier", new)


def tier_of_age(age_hours: Column, idle_hours: Column, thresholds: Mapping = THRESHOLDS) -> Column:
    """The tier that an artifact of this age and rest belongs in."""
    out = F.lit("hot")
    for tier, (age, idle) in thresholds.items():
        out = F.when((age_hours >= age) & (idle_hours >= idle), tier).otherwise(out)
    return out


def actions(registry: DataFrame, now: float, thresholds: Mapping = THRESHOLDS) -> DataFrame:
    """The moves of one run, without those that change nothing."""
    return cascade(registry, now, thresholds).where("tier <> new_tier").select("path", F.col("tier").alias("from_tier"), F.col("new_tier").alias("to_tier"), "original_size")


def stats(registry: DataFrame) -> DataFrame:
    """Numbers and bytes of each tier and, with a null tier, of all."""
    comp = F.col("compressed_size") > 0
    out = registry.groupingSets([["tier"], []], "tier").agg(
        F.count("*").alias("n"),
        F.sum("original_size").alias("original"),
        F.coalesce(F.sum(F.when(comp, F.col("compressed_size"))), F.lit(0)).alias("compressed"),
        F.coalesce(F.sum(F.when(F.col("tier") == "hot", F.col("original_size"))), F.lit(0)).alias("hot"),
    )
    ratio = F.when(F.col("compressed") > 0, F.round(F.col("original") / F.col("compressed"), 2)).otherwise(1.0)
    saved = F.when(F.col("compressed") > 0, F.col("original") - F.col("hot") - F.col("compressed")).otherwise(0)
    return out.select("tier", "n", F.col("original").alias("original_size"), F.col("compressed").alias("compressed_size"), ratio.alias("overall_ratio"), saved.alias("space_saved"))


def context_stats(entries: DataFrame) -> DataFrame:
    """Entries, keywords and characters of each tier."""
    return entries.groupBy("tier").agg(F.count("*").alias("n"), F.sum(F.size("keywords")).cast("long").alias("total_keywords"), F.sum("char_count").alias("total_chars"))


def ratios(original: Column, compressed: Column) -> tuple[Column, Column]:
    """The ratio to two places and the savings in percent to one."""
    return F.when(compressed > 0, F.round(original / compressed, 2)).otherwise(0.0), F.when(original > 0, F.round((1 - compressed / original) * 100, 1)).otherwise(0.0)


def compactable(hot: DataFrame, now: float, age_hours: float = 48, idle_hours: float = 24) -> DataFrame:
    """Hot rows old enough to be written to the store."""
    return hot.where(F.lit(float(now)) - F.col("last_modified") >= max(age_hours, idle_hours) * 3600)


def retained(recycled: DataFrame, now: float, days: float = 7) -> DataFrame:
    """Recycled rows that are not yet to be deleted."""
    return recycled.where(F.lit(float(now)) - F.col("recycled_at") <= days * 86400)


def rollup(rows: DataFrame, date: str, unit: str, *measures: Column) -> DataFrame:
    """Batches of weeks, months or quarters."""
    return rows.groupBy(F.date_format(F.date_trunc(unit, F.col(date)), "yyyy-MM-dd").alias("period")).agg(*measures)


def changed(files: DataFrame, state: DataFrame) -> DataFrame:
    """Files that ``state`` has not with this time of change."""
    same = (F.col("f.path") == F.col("s.path")) & F.col("f.mtime").eqNullSafe(F.col("s.mtime"))
    return files.alias("f").join(state.alias("s"), same, "left_anti")
