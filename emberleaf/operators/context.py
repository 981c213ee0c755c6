"""Context for a prompt: sections under a budget of characters, and layered assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberleaf.functions import text as t

CHARS_PER_TOKEN, BUDGET, LEAST_FOR_WARM = 4, 128_000, 200
TRUNCATED = "\n\n[...truncated to token budget]"


def budgeted(rows: DataFrame, order: str, size: str, budget: int, group: list[str]) -> DataFrame:
    """The rows of each group up to the first that does not fit its budget."""
    from pyspark.sql import Window as W

    total = F.sum(size).over(W.partitionBy(*group).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("used", total).where(F.col("used") <= budget)


def build(entries: DataFrame, query: str | None, budget: int = BUDGET, most: int = 20) -> DataFrame:
    """One row: the ``context`` of a session and the characters ``used``.

    ``entries`` has path, tier, char_count, age_days, last_accessed, summary, keywords and relevance. Sections
    are recent hot entries, relevant ones of other tiers and recent warm ones without relevance; an entry that does not fit
    ends its section, and what a section leaves goes to the next. At most some dozens of lines are gathered, the best by
    distributed top-k.
    """
    line = t.context_line(F.col("tier"), F.col("path"), F.col("char_count"), F.col("age_days"), F.col("summary"))
    rows = entries.withColumn("line", line)
    block = t.context_block(F.col("tier"), F.col("line"), F.col("keywords"))
    recent = (F.desc("last_accessed"), F.asc("path"))

    def section(number: int, df: DataFrame, order, k: int, text: Column) -> DataFrame:
        items = df.orderBy(*order).limit(k).select(F.struct(F.lit(number).alias("section"), *(c.alias(f"o{i}") for i, c in enumerate(_keys(order)))).alias("o"), F.concat(text, F.lit("\n")).alias("text"))
        return items.agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "text"))), lambda x: x["text"]).alias(f"s{number}"))

    hot = section(1, rows.where("tier = 'hot'"), recent, most // 2, F.col("line"))
    best = section(2, rows.where("relevance > 0"), (F.desc("relevance"), F.asc("path")), most, F.when(F.col("tier") != "hot", block)) if query else None
    warm = section(3, rows.where("tier = 'warm' and relevance = 0"), recent, 5, F.col("line"))
    counts = rows.agg(F.count_if(F.col("tier") == "cold").alias("cold"), F.count_if(F.col("tier") == "frozen").alias("frozen"))
    one = hot.crossJoin(warm).crossJoin(counts)
    one = one.crossJoin(best.select(F.filter("s2", lambda x: x.isNotNull()).alias("s2"))) if best is not None else one.withColumn("s2", F.array().cast("array<string>"))

    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("used"), F.lit(False).alias("stop"))

    def add(state: Column, x: Column, always: bool) -> Column:
        fits = ~state["stop"] & (state["used"] + F.length(x) <= budget)
        shown = F.lit(True) if always else fits
        return F.struct(F.when(shown, F.concat(state["out"], x)).otherwise(state["out"]).alias("out"), F.when(fits, state["used"] + F.length(x)).otherwise(state["used"]).alias("used"), (F.lit(False) if always else state["stop"] | ~fits).alias("stop"))

    def step(state: Column, header: Column, items: Column, ok: Column) -> Column:
        opened = add(F.struct(state["out"].alias("out"), state["used"].alias("used"), F.lit(False).alias("stop")), header, True)
        filled = F.aggregate(items, opened, lambda s, x: add(s, x, False))
        return F.when(ok & (F.size(items) > 0), filled).otherwise(state)

    safe = F.trim(t.sanitize_query(F.lit(query or "")))
    folded = t.let(add(state, F.lit("## Memory Context (auto-loaded)\n"), False), lambda s: step(s, F.lit("### Recent (hot tier)\n"), F.col("s1"), F.lit(True)))
    folded = t.let(folded, lambda s: step(s, F.concat(F.lit('\n### Relevant to: "'), safe, F.lit('"\n')), F.col("s2"), F.lit(True)))
    folded = t.let(folded, lambda s: step(s, F.lit("\n### Archived (warm tier)\n"), F.col("s3"), budget - s["used"] > LEAST_FOR_WARM))
    note = F.when((F.col("cold") > 0) | (F.col("frozen") > 0), F.concat(F.lit("\n**Archived memories:** "), F.col("cold").cast("string"), F.lit(" cold, "), F.col("frozen").cast("string"), F.lit(" frozen.\n"))).otherwise("")
    out = one.select(folded.alias("f"), note.alias("note"))
    percent = F.round(F.col("f.used") / budget * 100, 1).cast("string")
    footer = F.concat(F.lit("\n---\nMemory: "), percent, F.lit("% of context budget used (~"), F.floor((budget - F.col("f.used")) / CHARS_PER_TOKEN).cast("string"), F.lit(" tokens remaining)."), F.col("note"), F.lit("\n"))
    return out.select(F.when(F.lit(budget >= 32), F.concat("f.out", footer)).otherwise("").alias("context"), F.col("f.used").cast("long").alias("used"))


def _keys(order) -> list[Column]:
    """Columns that sort ascending as ``order`` does."""
    return [(-F.col("last_accessed")), F.col("path")] if "last_accessed" in str(order[0]) else [(-F.col("relevance")), F.col("path")]


def assemble(layers: DataFrame, facts: DataFrame, episodes: DataFrame, now: Column, budget_tokens: int = 2000, max_facts: int = 5, max_episodes: int = 3) -> DataFrame:
    """One row: ``context``, ``token_estimate``, ``facts_injected`` and ``episodes_injected``.

    Facts that have expired or are of high sensitivity are left out before the best are taken.
    """
    alive = F.coalesce(F.try_to_timestamp("expires_at") >= now, F.lit(True))
    conf, sig = F.coalesce("confidence", F.lit(0.5)), F.coalesce("significance", F.lit(0.5))
    top = facts.where(alive & (F.coalesce("sensitivity", F.lit("low")) != "high")).orderBy(conf.desc(), sig.desc(), "artifact_id").limit(max_facts)
    fact = F.concat(F.lit("- ["), "source_label", F.lit("] (conf:"), F.format_string("%.1f", F.bround(conf, 1)), F.lit(") "), F.left("content", F.lit(200)))
    lines = lambda df, key, line: df.select(F.struct(*key, line.alias("line")).alias("x")).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]).alias("a"))
    one = lines(top, [(-conf).alias("k1"), (-sig).alias("k2"), F.col("artifact_id").alias("k3")], fact).withColumnRenamed("a", "facts")
    ep = episodes.where("memory_type = 'episode'").orderBy(F.desc("created_date"), "artifact_id").limit(max_episodes)
    shown = F.concat(F.lit("- ["), "created_date", F.lit("] "), F.left(F.coalesce("summary", "content"), F.lit(300)))
    two = lines(ep, [(-F.unix_date(F.to_date("created_date"))).alias("k1"), F.col("artifact_id").alias("k2")], shown).withColumnRenamed("a", "episodes")
    three = lines(layers, [F.col("position")], F.concat(F.lit("## "), "title", F.lit("\n"), "body")).withColumnRenamed("a", "layers")
    block = lambda title, c: F.when(F.size(c) > 0, F.concat(F.lit(f"## {title} ("), F.size(c).cast("string"), F.lit(")\n"), F.array_join(c, "\n")))
    text = F.concat_ws("\n\n", F.when(F.size("layers") > 0, F.array_join("layers", "\n\n")), block("Relevant Facts", F.col("facts")), block("Recent Episodes", F.col("episodes")))
    most = budget_tokens * CHARS_PER_TOKEN
    cut = F.when(F.length("text") > most, F.concat(F.left("text", F.lit(most)), F.lit(TRUNCATED))).otherwise(F.col("text"))
    rows = one.crossJoin(two).crossJoin(three).withColumn("text", text)
    return rows.select(cut.alias("context"), F.floor(F.length(cut) / CHARS_PER_TOKEN).alias("token_estimate"), F.size("facts").cast("long").alias("facts_injected"), F.size("episodes").cast("long").alias("episodes_injected"))
