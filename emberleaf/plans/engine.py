"""A memory engine over one folder: ingest, tier, search, recall, verify and govern.

Artifacts are one append-only Parquet table. What changes (tier, last access, pin) is a small
registry whose versions are whole tables: a new version is written beside the old one, and readers take the newest complete one.
Pins, removals and recalls are appended to it as touches and folded in by the next version. A full-text index and the
supersession links are stored too; a search reads these, not the texts.
"""

from __future__ import annotations

import time
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberleaf.functions import classify
from emberleaf.operators import context, governance, lifecycle, search, store, supersession
from emberleaf.plans.config import Config
from emberleaf.sources import files, sinks

REGISTRY = "artifact_id string, tier string, created_at double, last_accessed double, original_size long, pinned boolean, removed boolean, compressed_size long"
TOUCHED = "artifact_id string, at long, tier string, last_accessed double, pinned boolean, removed boolean"
LINKS = "id string, by string, `end` string"
STATE = "path string, mtime timestamp"
FIELDS = ("content", "summary", "technology", "category", "action", "domain", "entities")


class MemoryEngine:
    def __init__(self, spark: SparkSession, root: str, config: Config | None = None) -> None:
        self.spark, self.root, self.config = spark, root.rstrip("/"), config or Config()

    # tables

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _version(self, name: str) -> int:
        fs, path = self._fs()
        folder = path(f"{self.root}/{name}")
        if not fs.exists(folder):
            return -1
        done = [int(s.getPath().getName()[1:]) for s in fs.listStatus(folder) if fs.exists(path(f"{s.getPath().toString()}/_SUCCESS"))]
        return max(done, default=-1)

    def _read(self, name: str, schema: str) -> DataFrame:
        v = self._version(name)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}/v{v}") if v >= 0 else self.spark.createDataFrame([], schema)

    def _replace(self, name: str, df: DataFrame) -> None:
        """A new version, then removal of all but the newest two."""
        v = self._version(name)
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/v{v + 1}")
        fs, path = self._fs()
        if v >= 1:
            fs.delete(path(f"{self.root}/{name}/v{v - 1}"), True)
        if name == "registry":
            fs.delete(path(f"{self.root}/touches"), True)

    def artifacts(self) -> DataFrame:
        """All artifacts that are not removed, with their registry columns."""
        fs, path = self._fs()
        where = f"{self.root}/artifacts"
        schema = files.artifact_schema()
        rows = self.spark.read.schema(schema).parquet(where) if fs.exists(path(where)) else self.spark.createDataFrame([], schema)
        return rows.join(self.registry().where("not removed").drop("original_size", "compressed_size"), "artifact_id")

    def registry(self) -> DataFrame:
        """The newest version with what touched it since."""
        rows = self._read("registry", REGISTRY)
        fs, path = self._fs()
        where = f"{self.root}/touches"
        if not fs.exists(path(where)):
            return rows
        columns = ("tier", "last_accessed", "pinned", "removed")
        last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(f"{c}_") for c in columns]
        new = self.spark.read.schema(TOUCHED).json(where).groupBy("artifact_id").agg(*last)
        both = rows.join(new, "artifact_id", "left")
        return both.select(*(F.coalesce(f"{c}_", c).alias(c) if c in columns else F.col(c) for c in rows.columns))

    # writing

    def add(self, label: str, path: str) -> None:
        """A source folder to scan."""
        self.config = Config(**{**self.config.__dict__, "sources": {**self.config.sources, label: path}})

    def _append(self, rows: DataFrame, now: float) -> int:
        """New artifacts by id; known ids are skipped, copies written once."""
        known = self.registry().select("artifact_id")
        fresh = rows.dropDuplicates(["artifact_id"]).join(known, "artifact_id", "left_anti").persist()
        n = fresh.count()
        if n:
            sinks.write_batch(fresh, f"{self.root}/artifacts")
            search.write_index(self._fields(fresh), "artifact_id", FIELDS, f"{self.root}/index")
            new = fresh.select("artifact_id", F.lit("hot").alias("tier"), F.lit(now).alias("created_at"), F.lit(now).alias("last_accessed"), "original_size", F.lit(False).alias("pinned"), F.lit(False).alias("removed"), F.lit(0).cast("long").alias("compressed_size"))
            self._replace("registry", self.registry().unionByName(new))
            self._relink()
        fresh.unpersist()
        return n

    @staticmethod
    def _fields(rows: DataFrame) -> DataFrame:
        return rows.select("artifact_id", "content", "summary", *(F.array_join(F.col(f"semantic.{f}"), " ").alias(f) for f in FIELDS[2:]))

    def _relink(self) -> None:
        """Stores which artifact supersedes which, after artifacts came or went."""
        links = self.supersessions()
        self._replace("links", links.join(supersession.chain_ends(links), "id"))

    def reindex(self) -> int:
        """Builds the index and the links anew from the artifacts; the number of artifacts."""
        rows = self.artifacts()
        fresh = f"{self.root}/index.new"
        search.write_index(self._fields(rows), "artifact_id", FIELDS, fresh, "overwrite")
        fs, path = self._fs()
        fs.delete(path(f"{self.root}/index"), True)
        fs.rename(path(fresh), path(f"{self.root}/index"))
        self._relink()
        return rows.count()

    def save_config(self) -> None:
        """Writes the settings beside the tables."""
        fs, path = self._fs()
        out = fs.create(path(f"{self.root}/config.json"), True)
        out.write(self.config.to_json().encode())
        out.close()

    def saved_config(self) -> Config | None:
        fs, path = self._fs()
        where = f"{self.root}/config.json"
        return Config.from_json(self.spark.read.text(where, wholetext=True).first()[0]) if fs.exists(path(where)) else None

    def run(self, now: float, dry_run: bool = False) -> dict[str, int]:
        """Ingests changed files of all sources and moves artifacts between tiers."""
        added = 0
        state = self._read("state", STATE)
        for label, path in self.config.sources.items():
            raw = files.read_bytes(self.spark, path, self.config.pattern)
            changed = lifecycle.changed(raw, state)
            if not dry_run:
                added += self._append(files.ingest(changed, label), now)
        if not dry_run and self.config.sources:
            seen = None
            for path in self.config.sources.values():
                part = files.scan(self.spark, path, self.config.pattern).select("path", "mtime")
                seen = part if seen is None else seen.unionByName(part)
            self._replace("state", seen)
        moved = self.tier(now, dry_run).count()
        return {"added": added, "moved": moved}

    def tier(self, now: float, dry_run: bool = False) -> DataFrame:
        """Moves of one tiering run; pinned artifacts stay."""
        rows = lifecycle.cascade(self.registry().where("not pinned and not removed"), now, self.config.thresholds)
        moves = rows.where("tier <> new_tier").select("artifact_id", F.col("tier").alias("from_tier"), F.col("new_tier").alias("to_tier")).persist()
        if not dry_run and not moves.isEmpty():
            old = self.registry()
            sizes = None
            for name, level in sinks.LEVELS.items():
                texts = self.artifacts().join(moves.where(F.col("to_tier") == name), "artifact_id", "left_semi").select("artifact_id", "content")
                own = sinks.compress(texts, "content", level).select("artifact_id", F.col("compressed_size").alias("new_size"))
                sizes = own if sizes is None else sizes.unionByName(own)
            new = old.join(moves.select("artifact_id", "to_tier"), "artifact_id", "left").join(sizes, "artifact_id", "left")
            new = new.withColumn("tier", F.coalesce("to_tier", "tier")).withColumn("compressed_size", F.coalesce("new_size", "compressed_size")).select(*old.columns)
            self._replace("registry", new)
        return moves

    def _ingest_rows(self, requests: DataFrame, now: float) -> int:
        body = requests.select(F.col("label"), F.col("content").cast("binary").alias("content"), F.concat(F.lit("note/"), "label").alias("path"), F.timestamp_seconds(F.lit(now)).alias("mtime"), "namespace", "confidence", "source")
        made = files.ingest(body.select("path", "mtime", "content"), "tool")
        extra = body.select(F.left(F.sha2("content", 256), F.lit(16)).alias("artifact_id"), F.col("label").alias("l"), F.col("namespace").alias("ns"), F.col("confidence").cast("float").alias("c"), F.col("source").alias("p")).dropDuplicates(["artifact_id"])
        rows = made.join(extra, "artifact_id").withColumns({"source_label": F.col("l"), "namespace": F.col("ns"), "confidence": F.col("c"), "source_provenance": F.col("p")}).drop("l", "ns", "c", "p")
        return self._append(rows, now)

    def ingest(self, content: str, label: str, now: float) -> int:
        """One text; 0 if it is too short or known."""
        return self._ingest_rows(self.spark.createDataFrame([(label, content, "user", 0.5, "explicit")], "label string, content string, namespace string, confidence double, source string"), now)

    def ingest_governed(self, requests: DataFrame, now: float) -> DataFrame:
        """Writes what the policy lets pass and logs every request; returns requests with their status."""
        known = self.artifacts().select("artifact_id", F.col("source_label").alias("key"), "namespace")
        gated = governance.gate(requests, known).persist()
        governance.write_audit(governance.audit(gated, F.timestamp_seconds(F.lit(now))), f"{self.root}/audit")
        self._ingest_rows(gated.where("status = 'ingested'").withColumn("confidence", F.coalesce("adjusted_confidence", "confidence")), now)
        return gated

    def _touch(self, artifact_id: str, **values) -> None:
        """One line beside the registry; the last one of a column counts."""
        row = {"artifact_id": artifact_id, "at": time.time_ns(), **values}
        self.spark.createDataFrame([row], ", ".join(f for f in TOUCHED.split(", ") if f.split()[0] in row)).coalesce(1).write.mode("append").json(f"{self.root}/touches")

    def pin(self, artifact_id: str) -> None:
        self._touch(artifact_id, pinned=True)

    def remove(self, artifact_id: str) -> None:
        self._touch(artifact_id, removed=True)
        self._relink()

    # reading

    def supersessions(self) -> DataFrame:
        rows = self.artifacts().select(F.col("artifact_id").alias("id"), classify.topic_kind("content").alias("kind"), classify.topic_terms("content").alias("terms"), "created_date")
        return supersession.superseded_by(supersession.register(rows))

    def search(self, query: str, limit: int = 10, after: str | None = None, before: str | None = None) -> DataFrame:
        """The best artifacts by BM25 over seven fields with synonyms, after supersession and within dates."""
        live = self.registry().where("not removed").select("artifact_id")
        if self._version("registry") < 0:
            return self.spark.createDataFrame([], "id string, score double, superseded boolean, summary string, tier string, created_date string")
        hits = search.indexed_bm25(self.spark, f"{self.root}/index", search.expanded_terms(query), among=live).withColumnRenamed("key", "artifact_id")
        if after or before:
            dates = self.artifacts().select("artifact_id", "created_date")
            for bound, keep in ((after, F.col("created_date") > F.lit(after)), (before, F.col("created_date") < F.lit(before))):
                dates = dates.where(keep) if bound else dates
            hits = hits.join(dates, "artifact_id", "left_semi")
        top = search.top(hits, "artifact_id", "score", 3 * limit).select(F.col("artifact_id").alias("id"), "score")
        links = self._read("links", LINKS)
        out = supersession.adjust(top, links.select("id", "by"), links.select("id", "end"), self.config.hide_superseded).limit(limit)
        return out.join(self.artifacts().select(F.col("artifact_id").alias("id"), "summary", "tier", "created_date"), "id").orderBy(F.desc("score"), "id")

    def recall(self, artifact_id: str, now: float) -> DataFrame:
        """Content of one artifact if its hash holds; it counts as accessed."""
        ids = self.spark.createDataFrame([(artifact_id,)], "artifact_id string")
        out = store.recall(self.artifacts().drop("last_accessed"), ids, now).persist()
        if not out.where("status = 'ok'").isEmpty():
            self._touch(artifact_id, last_accessed=float(now), tier="hot")
        return out

    def status(self) -> DataFrame:
        """Numbers and bytes of each tier and, with a null tier, of all, there with indexed artifacts and keywords."""
        every = self.artifacts().agg(F.count("*").alias("indexed_artifacts"), F.coalesce(F.sum(F.size("keywords")), F.lit(0)).cast("long").alias("total_keywords"))
        return lifecycle.stats(self.registry().where("not removed")).join(F.broadcast(every), F.col("tier").isNull(), "left")

    def index_stats(self) -> DataFrame:
        """Documents and terms of each indexed field."""
        return search.index_stats(self.spark, f"{self.root}/index")

    def store_stats(self) -> DataFrame:
        """Files, bytes and rows of the artifact store."""
        return sinks.store_stats(self.spark, f"{self.root}/artifacts")

    def verify(self) -> DataFrame:
        return store.verification(store.verified(self.artifacts()), "artifact_id")

    def context(self, query: str, now: float, budget_chars: int = context.BUDGET) -> DataFrame:
        day = 86400.0
        rows = self.artifacts()
        idle = (F.lit(float(now)) - F.col("last_accessed")) / day
        entries = rows.select(F.col("source_path").alias("path"), "tier", F.length("content").alias("char_count"), ((F.lit(float(now)) - F.col("created_at")) / day).alias("age_days"), "last_accessed", "summary", "keywords", search.relevance(query.lower().split(), F.col("keywords"), F.col("summary"), F.col("source_path"), idle).alias("relevance"))
        return context.build(entries, query, budget_chars)


def utc(text: str) -> float:
    """Seconds since the epoch of an ISO date."""
    return datetime.fromisoformat(text).replace(tzinfo=UTC).timestamp()
