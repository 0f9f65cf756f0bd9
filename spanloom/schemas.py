"""The extraction schema (kinds, exact-match kinds, relation signatures) and its checks."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LABEL = re.compile(r"^[a-z][a-z_]*$")
# Labels with a meaning of their own.
RESERVED = ("none", "not_an_entity", "entity", "mention", "source_document")


class BadInput(ValueError):
    """Input that the user has to mend."""


@dataclass(frozen=True)
class Relation:
    domain: tuple[str, ...]
    range: tuple[str, ...]
    text: str


@dataclass(frozen=True)
class ExtractionSchema:
    kinds: dict[str, str]
    exact: tuple[str, ...]
    relations: dict[str, Relation]

    def kinds_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, k, d, k in self.exact) for i, (k, d) in enumerate(self.kinds.items())], "ordinal int, kind string, description string, exact_only boolean")

    def signatures_df(self, spark: SparkSession) -> DataFrame:
        """One row for each relation, domain kind and range kind; small by nature, so joins broadcast it."""
        rows = [(i, name, a, b, r.text) for i, (name, r) in enumerate(self.relations.items()) for a in r.domain for b in r.range]
        return spark.createDataFrame(rows, "ordinal int, relation string, domain_kind string, range_kind string, text string")


def parse_schema(raw: dict) -> ExtractionSchema:
    kinds, exact, relations = raw.get("entities") or {}, tuple(raw.get("exactMatchOnly") or ()), raw.get("relations") or {}
    if not kinds:
        raise BadInput("a schema needs at least one entity kind")
    for label in (*kinds, *relations):
        if not LABEL.match(label) or label in RESERVED:
            raise BadInput(f"unusable label {label!r}")
    if empty := [k for k, d in kinds.items() if not str(d).strip()]:
        raise BadInput(f"kinds without a description: {empty}")
    out = {}
    for name, r in relations.items():
        if not r.get("domain") or not r.get("range"):
            raise BadInput(f"{name}: domain and range can't be empty")
        out[name] = Relation(tuple(r["domain"]), tuple(r["range"]), r.get("text", ""))
    named = {*exact, *(k for r in out.values() for k in (*r.domain, *r.range))}
    if unknown := sorted(named - set(kinds)):
        raise BadInput(f"kinds that aren't declared: {unknown}")
    return ExtractionSchema(dict(kinds), exact, out)


def load_schema(path: str) -> ExtractionSchema:
    return parse_schema(json.loads(Path(path).read_text()))


def safe_label(label: Column) -> Column:
    return F.when(label.rlike(LABEL.pattern), label).otherwise(F.raise_error(F.concat(F.lit("unsafe label "), label)).cast("string"))


def relationship_type(label: Column) -> Column:
    """works_for -> WORKS_FOR."""
    return F.upper(safe_label(label))


def node_label(label: Column) -> Column:
    """geo_feature -> GeoFeature."""
    return F.replace(F.initcap(F.replace(safe_label(label), F.lit("_"), F.lit(" "))), F.lit(" "), F.lit(""))
