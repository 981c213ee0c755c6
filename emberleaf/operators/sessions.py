"""Conversation sessions: summaries, keywords and system prompts kept once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberleaf.functions import lexicon
from emberleaf.functions import text as t

# Phrases that tell a decision.
DECISIONS = [
    r"(?i)(?:decided|decision|chose|choosing|picked|selected|went with|going with)\s+(.{20,100})",
    r"(?i)(?:built|created|added|implemented|shipped|deployed)\s+(.{20,100})",
    r"(?i)(?:the (?:fix|solution|answer|result|approach) (?:is|was))\s+(.{20,100})",
]


def decision(text: Column) -> Column:
    """The first decision phrase of a message, cut at 100 characters, else null."""
    out = F.lit(None).cast("string")
    for p in reversed(DECISIONS):
        hit = F.regexp_extract(text, p, 0)
        out = F.when(hit != "", F.left(hit, F.lit(100))).otherwise(out)
    return out


def summaries(messages: DataFrame, session: str, order: str, role: str, text: str, most: int = 300) -> DataFrame:
    """``summary`` of each session: its first human message and decisions of its first ten assistant messages.

    Messages of a session are numbered by a window and only those that matter are gathered.
    """
    rows = messages.select(F.col(session), F.col(order).alias("o"), F.col(role).alias("role"), t.text(text).alias("text"))
    nth = F.row_number().over(W.partitionBy(session, "role").orderBy("o"))
    rows = rows.withColumn("n", nth)
    head = F.max(F.when((F.col("role") == "human") & (F.col("n") == 1), F.regexp_replace(F.left("text", F.lit(200)), r"\[Image:.*?\]", "[image]"))).alias("head")
    said = F.when((F.col("role") == "assistant") & (F.col("n") <= 10), decision(F.col("text")))
    found = F.transform(F.array_sort(F.collect_list(F.when(said.isNotNull(), F.struct("o", said.alias("s"))))), lambda x: x["s"]).alias("found")
    start = F.transform(F.array_sort(F.collect_list(F.when(F.col("n") <= most, F.struct("o", F.left("text", F.lit(most)).alias("s"))))), lambda x: x["s"]).alias("start")
    g = rows.groupBy(session).agg(head, found, start)
    parts = F.left(F.array_join(F.filter(F.concat(F.array("head"), F.col("found")), lambda x: x.isNotNull()), ". "), F.lit(most))
    return g.select(session, F.when(parts != "", parts).otherwise(F.left(F.array_join("start", "\n\n"), F.lit(most))).alias("summary"))


def keywords(messages: DataFrame, session: str, role: str, text: str, most: int = 30) -> DataFrame:
    """The ``most`` best words of each session: their count, human messages' words three times; ties by code point."""
    words = messages.select(F.col(session), (F.col(role) == "human").cast("long").alias("h"), F.explode(t.session_tokens(text)).alias("word"))
    words = words.where(~F.col("word").isin(lexicon.SESSION_STOPS) & (F.length("word") >= 3) & ~F.col("word").rlike("^[0-9]+$") & ~F.col("word").rlike("^[0-9a-f]{8,}$"))
    scored = words.groupBy(session, "word").agg((F.count("*") + 2 * F.sum("h")).alias("score"))
    rank = F.row_number().over(W.partitionBy(session).orderBy(F.desc("score"), "word"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= most)


def conversation_text(messages: DataFrame, session: str, order: str, role: str, text: str) -> DataFrame:
    """A session as lines of who said what, each cut at 500 characters."""
    who = F.when(F.col(role) == "human", "Human: ").otherwise("Assistant: ")
    line = F.struct(F.col(order).alias("o"), F.concat(who, F.left(t.text(text), F.lit(500))).alias("s"))
    return messages.groupBy(session).agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["s"]), "\n").alias("conversation"))


def parse(lines: DataFrame, line: str = "value", path: str = "path", order: str = "n") -> DataFrame:
    """Messages of session logs: path, ``n``, role, text, timestamp, and the log's first session id and folder.

    A line is JSON of type user or assistant whose content is text or a list of blocks; others,
    bad JSON and texts of at most five characters are skipped.
    """
    j = F.col(line)
    get = lambda p: F.get_json_object(j, p)
    content = get("$.message.content")
    blocks = F.from_json(content, "array<struct<type:string,text:string>>")
    listed = F.array_join(F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"]), " ")
    text = F.trim(F.when(F.ltrim(content).startswith("["), listed).otherwise(content))
    rows = lines.where(F.try_parse_json(j).isNotNull() & get("$").startswith("{"))
    first = lambda p: F.first(get(p), ignorenulls=True).over(W.partitionBy(path).orderBy(order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    rows = rows.select(path, order, get("$.type").alias("type"), text.alias("text"), F.coalesce(get("$.timestamp"), F.lit("")).alias("timestamp"), first("$.sessionId").alias("session_id"), first("$.cwd").alias("cwd"))
    kept = rows.where(F.col("type").isin("user", "assistant") & (F.length("text") > 5))
    return kept.select(path, order, F.when(F.col("type") == "user", "human").otherwise("assistant").alias("role"), "text", "timestamp", F.coalesce("session_id", F.lit("")).alias("session_id"), F.coalesce("cwd", F.lit("")).alias("cwd"))


REF = "BOILERPLATE_REF:"


def strip_boilerplate(rows: DataFrame, text: str, is_boilerplate: Column) -> tuple[DataFrame, DataFrame]:
    """``rows`` with repeated blocks replaced by a reference, and the table ``ref``, ``block`` of the blocks."""
    ref = F.concat(F.lit(REF), F.left(F.sha2(t.text(text), 256), F.lit(32)))
    store = rows.where(is_boilerplate).groupBy(ref.alias("ref")).agg(F.first(text).alias("block"))
    return rows.withColumn(text, F.when(is_boilerplate, ref).otherwise(F.col(text))), store


def restore_boilerplate(rows: DataFrame, store: DataFrame, text: str) -> DataFrame:
    """The texts that ``strip_boilerplate`` replaced; a reference without a block stays."""
    return rows.join(store, rows[text] == store["ref"], "left").withColumn(text, F.coalesce("block", text)).drop("ref", "block")
