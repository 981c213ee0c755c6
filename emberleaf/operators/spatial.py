"""Spatial artifacts: registration by content, search, promotion, export and proximity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PEER_CONFIDENCE, EXPORT_LEAST = 0.3, 0.6


def identity(data: Column) -> Column:
    """SHA-256 of the data as JSON with sorted keys; ``data`` is a struct whose fields are in that order."""
    return F.sha2(F.to_json(data), 256)


def register(events: DataFrame) -> DataFrame:
    """One artifact for each content hash.

    ``events`` has sha256, artifact_type, confidence, source, seen_at and keywords. Confidence is the greatest,
    each peer adds a confirmation, keywords and type are those of the first event.
    """
    first = F.min(F.struct("seen_at", "artifact_type", "keywords", "source")).alias("f")
    g = events.groupBy("sha256").agg(first, F.max("confidence").alias("confidence"), F.count_if(F.col("source") == "peer").alias("peer_confirmations"), F.max("seen_at").alias("last_confirmed"))
    return g.select(F.left("sha256", F.lit(16)).alias("artifact_id"), "sha256", "f.artifact_type", "f.keywords", "f.source", "confidence", "peer_confirmations", F.col("f.seen_at").alias("created_at"), "last_confirmed")


def keywords(kind: Column, fields: dict[str, Column]) -> Column:
    """Distinct search words of an artifact by its type."""
    none = F.array().cast("array<string>")
    some = lambda *cs: F.filter(F.array(*cs), lambda x: x.isNotNull())
    get = lambda name: fields.get(name, F.lit(None))
    own = (
        F.when(kind == "hazard_marker", some(get("hazard_type"), get("direction")))
        .when(kind == "route_segment", F.concat(F.coalesce(fields.get("detected_objects", none), none), F.coalesce(fields.get("hazards", none), none)))
        .when(kind == "poi", F.concat(some(get("poi_type")), F.coalesce(fields.get("attributes", none), none)))
        .when(kind == "room_scan", F.concat(F.array(F.lit("indoor"), F.lit("room")), some(F.when(get("door_count").isNotNull(), "door"), F.when(get("stair_count").isNotNull(), "stairs"))))
        .otherwise(none)
    )
    return F.array_distinct(F.concat(F.array(kind), own))


def search(artifacts: DataFrame, query: str, k: int | None = None) -> DataFrame:
    """Artifacts with a keyword that holds a term of ``query``, by confidence."""
    hit = F.lit(False)
    for term in query.lower().split():
        hit |= _holds(term)
    out = artifacts.where(hit).orderBy(F.desc("confidence"), "sha256")
    return out.limit(k) if k else out


def _holds(term: str) -> Column:
    return F.exists("keywords", lambda w: F.contains(F.lower(w), F.lit(term)))


def promote(artifacts: DataFrame, confirmations: DataFrame) -> DataFrame:
    """Confidence raised to that of later confirmations (``sha256``, ``confidence``)."""
    best = confirmations.groupBy("sha256").agg(F.max("confidence").alias("c"))
    return artifacts.join(best, "sha256", "left").withColumn("confidence", F.greatest("confidence", F.coalesce("c", "confidence"))).drop("c")


def exportable(artifacts: DataFrame, least: float = EXPORT_LEAST) -> DataFrame:
    """Hazards of enough confidence, without their positions."""
    rows = artifacts.where((F.col("artifact_type") == "hazard_marker") & (F.col("confidence") >= least))
    return rows.drop(*(c for c in ("position", "positions", "x", "y", "data") if c in rows.columns))


def of_type(artifacts: DataFrame, kind: str, least: float = 0.0) -> DataFrame:
    return artifacts.where((F.col("artifact_type") == kind) & (F.col("confidence") >= least))


def stats(artifacts: DataFrame) -> DataFrame:
    return artifacts.groupBy("artifact_type").agg(F.count("*").alias("n"), F.count_if(F.col("source") == "peer").alias("peers"))


def near(points: DataFrame, queries: DataFrame, metres: float, key: str = "id", query_key: str = "query_id") -> DataFrame:
    """Pairs of a query and a point (``x``, ``y`` in metres) at most ``metres`` apart.

    Both are dealt to square cells of that width; a query looks in its own cell and the eight around it.
    """
    cell = lambda c: F.floor(F.col(c) / metres).cast("long")
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    asked = queries.select(query_key, F.col("x").alias("qx"), F.col("y").alias("qy"), cell("x").alias("ci"), cell("y").alias("cj"), F.explode(around).alias("d")).select(query_key, "qx", "qy", (F.col("ci") + F.col("d.i")).alias("ci"), (F.col("cj") + F.col("d.j")).alias("cj"))
    rows = points.withColumn("ci", cell("x")).withColumn("cj", cell("y"))
    dx, dy = F.col("x") - F.col("qx"), F.col("y") - F.col("qy")
    d = F.sqrt(dx * dx + dy * dy)
    # few bytes of points make many pairs, so cells are dealt over tasks and not broadcast to the one that reads a small file
    return rows.join(asked.hint("merge"), ["ci", "cj"]).where(d <= metres).select(query_key, key, d.alias("distance"))
