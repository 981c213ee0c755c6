"""What each tier does to content on the way in, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberleaf.functions import text as t
from emberleaf.operators.sessions import restore_boilerplate, strip_boilerplate
from emberleaf.sources import sinks


def store(rows: DataFrame, tier: str, dictionary: bytes | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Rows (``artifact_id``, ``content``) compressed for ``tier``, and the table of blocks taken out.

    JSON lines are written in compact form, in every tier; repeated blocks are kept once for cold and frozen. The original
    content's hash goes along.
    """
    own = rows.select("artifact_id", "content", F.sha2(t.text("content"), 256).alias("content_hash"))
    slim = own.withColumn("content", F.when(t.looks_like_jsonl("content"), t.minify_json("content")).otherwise(F.col("content")))
    blocks = None
    if tier != "warm":
        slim, blocks = strip_boilerplate(slim, "content", t.is_boilerplate("content"))
    out = sinks.compress(slim, "content", sinks.LEVELS[tier], dictionary if tier != "warm" else None)
    return out.drop("content").withColumn("tier", F.lit(tier)), blocks


def restore(stored: DataFrame, blocks: DataFrame | None, dictionary: bytes | None = None) -> DataFrame:
    """The content of rows that ``store`` made for one tier."""
    rows = sinks.decompress(stored, dictionary=dictionary).withColumnRenamed("restored", "content").drop("compressed")
    return restore_boilerplate(rows, blocks, "content") if blocks is not None else rows
