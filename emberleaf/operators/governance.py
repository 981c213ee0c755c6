"""Governed writes: policy, schema check, conflicts, audit; layers, decay and expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberleaf.functions import classify as c

CEILING, FLOOR, TTL_HOURS = 0.8, 0.3, 72


def policy(content: Column, label: Column, confidence: Column, source: Column, key: Column) -> Column:
    """decision, reason, rule_id and adjusted_confidence of a write request; the first rule that holds wins."""
    cred, pii, blocked = c.credential(content), c.pii(content), c.blocked_key(key)
    capped = F.when((source == "inferred") & (confidence > CEILING), CEILING).otherwise(confidence)
    text = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    result = lambda decision, reason, rule, adjusted: F.struct(F.lit(decision).alias("decision"), reason.alias("reason"), (rule if isinstance(rule, Column) else F.lit(rule)).alias("rule_id"), adjusted.cast("double").alias("adjusted_confidence"))
    none = F.lit(None)
    explicit = F.when(label.isin("preference", "fact"), F.concat(F.lit("write_rules.explicit_"), label)).otherwise("write_rules.explicit_remember_instruction")
    return (
        F.when(cred.isNotNull(), result("rejected", text("Credential pattern detected: ", cred, ". Secrets are never stored in memory."), "blocklist.credentials", none))
        .when(pii.isNotNull(), result("rejected", text("PII pattern detected: ", pii, ". Record the preference without the PII."), "blocklist.pii", none))
        .when(blocked.isNotNull(), result("rejected", text("Key targets immutable namespace: blocked_key_prefix:", blocked, ". Security constraints belong in Layer 1 and hooks, not memory."), "blocklist.security_constraints", none))
        .when((source == "inferred") & (capped < FLOOR), result("rejected", text("Speculative inference with confidence < 0.3. Not written to durable memory."), "blocklist.speculative_inference", capped))
        .when(source == "explicit", result("approved", text("Explicit ", label, " — auto-write at confidence ", confidence.cast("string")), explicit, capped))
        .when(source == "inferred", result("pending", text("Inferred ", label, " from single session — requires confirmation. Confidence capped at ", capped.cast("string"), "."), "write_rules.inferred_single_session", capped))
        .when(source == "imported", result("approved", text("Imported ", label, " — auto-write"), "write_rules.imported", capped))
        .otherwise(result("rejected", text("Unknown source type: ", F.coalesce(source, F.lit("None"))), "unknown", none))
    )


def gate(requests: DataFrame, facts: DataFrame) -> DataFrame:
    """``requests`` with policy columns, ``status`` and the ``conflict_id`` of a stored fact with the same key and namespace.

    A conflict is reported and never blocks; the smallest id of several is named.
    """
    p = policy(*(F.col(x) for x in ("content", "label", "confidence", "source", "key")))
    known = facts.where(F.col("key").isNotNull()).groupBy("key", "namespace").agg(F.min("artifact_id").alias("conflict_id"))
    out = requests.withColumn("p", p).join(known, ["key", "namespace"], "left")
    status = F.when(F.col("p.decision") == "approved", "ingested").otherwise(F.col("p.decision"))
    rejected = F.col("p.decision") == "rejected"
    return out.select(*requests.columns, "p.*", status.alias("status"), F.when(~rejected, F.col("conflict_id")).alias("conflict_id"))


def audit(gated: DataFrame, now: Column) -> DataFrame:
    """Audit events of gated requests; they never hold content."""
    return gated.select(F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), F.col("status").alias("event"), "label", "key", "confidence", "source", "reason", "rule_id")


#: Bytes of a log after which nothing is added until it is rotated.
LOG_BYTES = 10 << 20


def audit_line(events: DataFrame) -> Column:
    """A line of the typed log for each of ``events`` (``ts``, ``op``, ``tier``, ``to_tier``, ``hash``, ``ratio``, ``ok``, ``n``, ``gen``).

    Operations are tier, recall, encrypt, decrypt, rotate, search and error. Six digits of a hash are shown, of an error
    without one a question mark; a line with a secret is replaced.
    """
    short, at = F.left(events["hash"], F.lit(6)), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    state = F.when(F.col("ok"), "ok").otherwise("fail")
    body = (
        F.when(F.col("op") == "tier", F.format_string("TIER %s>%s %.1fx %s", "tier", "to_tier", F.col("ratio").cast("double"), short))
        .when(F.col("op") == "recall", F.concat(F.lit("RECALL "), "tier", F.lit(" "), short))
        .when(F.col("op").isin("encrypt", "decrypt"), F.concat(F.upper("op"), F.lit(" "), "tier", F.lit(" "), short, F.lit(" "), state))
        .when(F.col("op") == "rotate", F.format_string("ROTATE %s gen%d>%d %dheaders", "tier", F.col("gen").cast("long"), (F.col("gen") + 1).cast("long"), F.col("n").cast("long")))
        .when(F.col("op") == "search", F.format_string("SEARCH %dhits", F.col("n").cast("long")))
        .otherwise(F.concat(F.lit("ERROR "), "op", F.lit(" "), F.coalesce(F.when(short != "", short), F.lit("?"))))
    )
    line = F.concat(at, F.lit(" "), body)
    return F.when(c.contains_secret(line), F.concat(at, F.lit(" REDACTED — log line contained potential secret/PII"))).otherwise(line)


def append_lines(lines: DataFrame, path: str, most: int = LOG_BYTES) -> bool:
    """Adds the column ``line`` of ``lines`` to a log below ``most`` bytes; a full one stays as it is."""
    spark = lines.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(folder) and fs.getContentSummary(folder).getLength() > most:
        return False
    lines.select("line").write.mode("append").text(path)
    return True


def write_audit(events: DataFrame, path: str) -> None:
    """Appends events as JSON lines without nulls."""
    events.write.mode("append").json(path)


def redacted(lines: DataFrame, line: str) -> DataFrame:
    """Log lines, those with a secret replaced."""
    return lines.withColumn(line, F.when(c.contains_secret(line), "[REDACTED: line contained secret material]").otherwise(F.col(line)))


def expired(created_at: Column, now: Column, hours: int = TTL_HOURS) -> Column:
    """Whether a session without a valid start, or older than ``hours``, is over."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.try_to_timestamp(created_at))
    return F.coalesce(age > hours * 3_600_000_000, F.lit(True))


def live_sessions(sessions: DataFrame, now: Column) -> DataFrame:
    return sessions.where(~expired(F.col("created_at"), now))


PRECEDENCE = {"system": 1, "app": 2, "env": 3, "user": 4, "session": 5}


def resolve_layers(settings: DataFrame) -> DataFrame:
    """The value in force for each key of ``settings`` (``layer``, ``key``, ``value``, ``mutability``), with the layer it is from.

    A key immutable in a lower layer keeps its value there; a session_only one counts from the session alone; an additive one joins all
    layers' values; else the highest layer wins.
    """
    rank = F.create_map(*(F.lit(x) for kv in PRECEDENCE.items() for x in kv))[F.col("layer")]
    rows = settings.withColumn("rank", rank)
    fixed = F.min(F.when(F.col("mutability") == "immutable", F.struct("rank", "value", "layer")))
    own = F.max(F.when(F.col("layer") == "session", F.struct("rank", "value", "layer")))
    top = F.max(F.struct("rank", "value", "layer"))
    kind = F.max(F.when(F.col("mutability").isin("additive", "session_only"), F.col("mutability")))
    every = F.array_join(F.array_sort(F.collect_set("value")), ",")
    g = rows.groupBy("key").agg(fixed.alias("fixed"), own.alias("own"), top.alias("top"), kind.alias("kind"), every.alias("every"))
    pick = F.when(F.col("fixed").isNotNull(), F.col("fixed")).when(F.col("kind") == "session_only", F.col("own")).otherwise(F.col("top"))
    value = F.when(F.col("fixed").isNull() & (F.col("kind") == "additive"), F.col("every")).otherwise(pick["value"])
    return g.select("key", value.alias("value"), pick["layer"].alias("layer")).where(F.col("value").isNotNull())


def decayed_confidence(source: Column, confidence: Column, days: Column) -> Column:
    """Half the confidence of an inferred fact unconfirmed for more than 90 days; null if it is to be deleted."""
    new = F.when((source == "inferred") & (days > 90), confidence * 0.5).otherwise(confidence)
    return F.when((source == "inferred") & (new < FLOOR), None).otherwise(new)


def episode_state(importance: Column, weeks: Column, pinned: Column, rate: float = 0.05) -> tuple[Column, Column]:
    """Importance after weekly decay and whether the episode is to be compacted."""
    now = importance * F.pow(F.lit(1 - rate), weeks)
    return now, ~pinned & ((now < 0.2) | ((weeks * 7 > 90) & (now < 0.5)))


def hebbian(strength: Column, recalls: Column, idle_weeks: Column, boost: float = 0.05, decay: float = 0.01) -> Column:
    """Strength raised by each recall and lowered by each idle week, within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), strength + boost * recalls - decay * idle_weeks))


def resolve_conflicts(facts: DataFrame) -> DataFrame:
    """For each key and namespace the fact that holds: explicit before others, then the higher confidence; a tie is to be reviewed."""
    score = F.struct((F.col("source") == "explicit").alias("x"), F.col("confidence").alias("c"))
    best = facts.groupBy("key", "namespace").agg(F.max(score).alias("s"), F.count("*").alias("n"))
    joined = facts.withColumn("s", score).join(best.withColumnRenamed("s", "top"), ["key", "namespace"]).where(F.col("s") == F.col("top"))
    return joined.groupBy("key", "namespace", "n").agg(F.min("artifact_id").alias("artifact_id"), F.when(F.count("*") > 1, "review").otherwise("resolved").alias("outcome"))


def duplicate_keys(facts: DataFrame) -> DataFrame:
    return facts.groupBy("namespace", "key").agg(F.count("*").alias("n")).where("n > 1")


def latest(log: DataFrame, order: str, key: str, most: int = 500) -> DataFrame:
    """The last ``most`` rows of a log."""
    return log.orderBy(F.desc(order), F.desc(key)).limit(most)


