"""The graph store: idempotent vertex and edge merges, orphan removal, and script export."""

from __future__ import annotations

import json
import math
import re
import uuid
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.schemas import relationship_type
from spanloom.sources import storage

# Uniqueness constraints of the script export.
CONSTRAINTS = (
    "CREATE CONSTRAINT entity_id IF NOT EXISTS FOR (n:Entity) REQUIRE n.id IS UNIQUE",
    "CREATE CONSTRAINT document_id IF NOT EXISTS FOR (n:SourceDocument) REQUIRE n.id IS UNIQUE",
    "CREATE CONSTRAINT mention_id IF NOT EXISTS FOR (n:Mention) REQUIRE n.id IS UNIQUE",
)


def without_documents(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """edges (doc_id, ..) of other documents: what a re-ingest leaves."""
    return edges.join(docs.select("doc_id").distinct(), "doc_id", "left_anti")


def without_orphans(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Entities that some edge (source_id, target_id) still touches."""
    touched = edges.select(F.explode(F.array("source_id", "target_id")).alias("entity_id")).distinct()
    return entities.join(touched, "entity_id", "left_semi")


def merge_entities(old: DataFrame, new: DataFrame) -> DataFrame:
    """Full outer merge on entity_id: aliases are the old ones that aren't new, then the new; the greater
    confidence; the new name and type where there is one."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col("o.entity_id") == F.col("n.entity_id"), "full_outer")
    none = F.array().cast("array<string>")
    was, now = F.coalesce("o.aliases", none), F.coalesce("n.aliases", none)
    return both.select(
        F.coalesce("n.entity_id", "o.entity_id").alias("entity_id"), F.coalesce("n.type", "o.type").alias("type"), F.coalesce("n.canonical_name", "o.canonical_name").alias("canonical_name"),
        F.concat(F.array_except(was, now), now).alias("aliases"), F.greatest("o.confidence", "n.confidence").alias("confidence"),
    )


def merge_relations(old: DataFrame, new: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges keyed by (source, type, target, document): a new one replaces an old one; without both ends an edge is skipped."""
    ids = entities.select("entity_id")
    whole = new.join(ids.withColumnRenamed("entity_id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("entity_id", "target_id"), "target_id", "left_semi")
    key = ["source_id", "type", "target_id", "doc_id"]
    return old.join(whole.select(key), key, "left_anti").unionByName(whole)


def mentioned_in(mentions: DataFrame) -> DataFrame:
    """(entity_id, doc_id, count, pages) edges from mentions (entity_id, doc_id, page)."""
    return mentions.groupBy("entity_id", "doc_id").agg(F.count("*").alias("count"), F.array_sort(F.collect_set("page")).alias("pages"))


def literal(x: Column) -> Column:
    """A string column as a script literal: JSON escapes, null."""
    quoted = F.regexp_extract(F.to_json(F.struct(x.alias("v"))), r'^\{"v":(.*)\}$', 1)
    return F.when(x.isNull(), "null").otherwise(quoted)


def entity_statements(entities: DataFrame) -> DataFrame:
    """One MERGE statement for each entity."""
    line = F.concat(F.lit("MERGE (n:Entity {id: "), literal(F.col("entity_id")), F.lit("}) SET n.canonicalName = "), literal(F.col("canonical_name")), F.lit(", n.type = "), literal(F.col("type")), F.lit(";"))
    return entities.select(line.alias("statement"))


def script_literal(value) -> str:
    """Python values as script literals; numbers that aren't finite become null."""
    if value is None or isinstance(value, float) and not math.isfinite(value):
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(script_literal, value)) + "]"
    if isinstance(value, dict):
        if bad := [k for k in value if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", k)]:
            raise ValueError(f"unsafe key {bad[0]!r}")
        return "{" + ", ".join(f"{k}: {script_literal(v)}" for k, v in value.items()) + "}"
    raise TypeError(f"no literal for {type(value).__name__}")


def inline_params(statement: str, params: dict) -> str:
    """$name replaced by its literal in one pass; values are not looked at again."""

    def value(m: re.Match) -> str:
        if m[1] not in params:
            raise KeyError(f"no parameter {m[1]}")
        return script_literal(params[m[1]])

    return re.sub(r"\$([A-Za-z_][A-Za-z0-9_]*)", value, statement)


def document_statements(docs: DataFrame) -> DataFrame:
    """docs: doc_id, sha256, path, title, page_count."""
    fields = [F.concat(F.lit(f", d.{name} = "), literal(F.col(c).cast("string"))) for name, c in (("sha256", "sha256"), ("path", "path"), ("title", "title"))]
    return docs.select(F.concat(F.lit("MERGE (d:SourceDocument {id: "), literal(F.col("doc_id").cast("string")), F.lit("}) SET d.pageCount = "), F.coalesce(F.col("page_count").cast("string"), F.lit("null")), *fields, F.lit(";")).alias("statement"))


def mentioned_statements(mentioned: DataFrame) -> DataFrame:
    """mentioned: entity_id, doc_id, count, pages."""
    pages = F.concat(F.lit("["), F.array_join(F.transform("pages", lambda p: p.cast("string")), ", "), F.lit("]"))
    return mentioned.select(F.concat(F.lit("MATCH (n:Entity {id: "), literal(F.col("entity_id")), F.lit("}), (d:SourceDocument {id: "), literal(F.col("doc_id").cast("string")), F.lit("}) MERGE (n)-[m:MENTIONED_IN]->(d) SET m.count = "), F.col("count").cast("string"), F.lit(", m.pages = "), pages, F.lit(";")).alias("statement"))


def relation_statements(relations: DataFrame) -> DataFrame:
    """relations: source_id, type, target_id, doc_id, count, confidence; types become edge names, which only safe labels can."""
    doc = literal(F.col("doc_id").cast("string"))
    return relations.select(F.concat(F.lit("MATCH (a:Entity {id: "), literal(F.col("source_id")), F.lit("}), (b:Entity {id: "), literal(F.col("target_id")), F.lit("}) MERGE (a)-[x:"), relationship_type(F.col("type")), F.lit(" {docId: "), doc, F.lit("}]->(b) SET x.confidence = "), F.coalesce(F.col("confidence").cast("string"), F.lit("null")), F.lit(", x.count = "), F.col("count").cast("string"), F.lit(";")).alias("statement"))


def mention_statements(mentions: DataFrame) -> DataFrame:
    """mentions: mention_id, entity_id, doc_id, text, start, end, confidence; a mention's id is its document's and its own."""
    doc = literal(F.col("doc_id").cast("string"))
    own = literal(F.concat_ws(":", F.col("doc_id").cast("string"), "mention_id"))
    fields = F.concat(F.lit(" SET n.docId = "), doc, F.lit(", n.text = "), literal(F.col("text")), F.lit(", n.start = "), F.col("start").cast("string"), F.lit(", n.end = "), F.col("end").cast("string"), F.lit(", n.confidence = "), F.coalesce(F.col("confidence").cast("string"), F.lit("null")))
    return mentions.where("entity_id is not null").select(F.concat(F.lit("MATCH (e:Entity {id: "), literal(F.col("entity_id")), F.lit("}), (d:SourceDocument {id: "), doc, F.lit("}) MERGE (n:Mention {id: "), own, F.lit("})"), fields, F.lit(" MERGE (n)-[:REFERS_TO]->(e) MERGE (d)-[:HAS_MENTION]->(n);")).alias("statement"))


def script(entities: DataFrame, documents: DataFrame | None = None, mentioned: DataFrame | None = None, relations: DataFrame | None = None, mentions: DataFrame | None = None) -> DataFrame:
    """(part, statement): constraints, documents, entities, then edges, by part in that order."""
    header = entities.sparkSession.createDataFrame([(f"{c};",) for c in CONSTRAINTS], "statement string")
    parts = [header, documents and document_statements(documents), entity_statements(entities), mentioned and mentioned_statements(mentioned), relations and relation_statements(relations), mentions and mention_statements(mentions)]
    out = None
    for i, x in enumerate(parts):
        if x is not None:
            x = x.select(F.lit(i).alias("part"), "statement")
            out = x if out is None else out.unionByName(x)
    return out


def export_script(path: str, entities: DataFrame, **others: DataFrame) -> None:
    script(entities, **others).sort("part").select("statement").write.mode("overwrite").text(path)


class GraphStore(Protocol):
    """What a store of graphs offers; a graph server would be another one."""

    def load(self, entities: DataFrame, relations: DataFrame, docs: DataFrame, mentioned: DataFrame | None = None, mentions: DataFrame | None = None) -> None: ...

    def counts(self) -> dict[str, int]: ...


class ParquetGraph:
    """Documents, entities, relations, MENTIONED_IN edges and mentions in versioned folders under a root.

    A load replaces what the loaded documents had, drops entities that no edge of any kind touches any
    more, writes a new version and, last, the next pointer file, which must not exist: a failed load
    leaves the old version, a repeated one changes nothing, and of two loads at once one fails.
    """

    TABLES = ("documents", "entities", "relations", "mentioned_in", "mentions")

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _pointers(self) -> list[str]:
        return [n for n in storage.names(self.spark, self.root) if n.startswith("CURRENT-")]

    def _now(self) -> str | None:
        found = self._pointers()
        return f"{self.root}/{storage.read_text(self.spark, f'{self.root}/{found[-1]}').strip()}" if found else None

    def read(self, table: str) -> DataFrame | None:
        now = self._now()
        return self.spark.read.parquet(f"{now}/{table}") if now else None

    def load(self, entities: DataFrame, relations: DataFrame, docs: DataFrame, mentioned: DataFrame | None = None, mentions: DataFrame | None = None) -> None:
        """docs: doc_id and what else is known of each; mentioned: entity_id, doc_id, count, pages; mentions: mention_id, entity_id, doc_id, .."""
        kind = docs.schema["doc_id"].dataType.simpleString()
        if mentioned is None:
            mentioned = self.spark.createDataFrame([], f"entity_id string, doc_id {kind}, count bigint, pages array<string>")
        if mentions is None:
            mentions = self.spark.createDataFrame([], f"mention_id string, entity_id string, doc_id {kind}")
        pointers = self._pointers()
        if pointers:
            kept = {t: without_documents(self.read(t), docs) for t in ("documents", "relations", "mentioned_in", "mentions")}
            edges = kept["relations"].select("source_id", "target_id").union(kept["mentioned_in"].select("entity_id", F.lit(None).cast("string")))
            entities = merge_entities(without_orphans(self.read("entities"), edges), entities)
            relations = merge_relations(kept["relations"], relations, entities)
            docs, mentioned, mentions = (kept[t].unionByName(x, allowMissingColumns=True) for t, x in (("documents", docs), ("mentioned_in", mentioned), ("mentions", mentions)))
        else:
            relations = merge_relations(relations.limit(0), relations, entities)
        version = f"v-{uuid.uuid4().hex}"
        for name, df in zip(self.TABLES, (docs, entities, relations, mentioned, mentions), strict=True):
            df.write.parquet(f"{self.root}/{version}/{name}")
        after = int(pointers[-1].removeprefix("CURRENT-")) + 1 if pointers else 0
        storage.create_text(self.spark, f"{self.root}/CURRENT-{after:09d}", version)

    def counts(self) -> dict[str, int]:
        return {t: self.read(t).count() if self._now() else 0 for t in self.TABLES}
