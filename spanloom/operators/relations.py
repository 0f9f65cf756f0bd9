"""Entity pairs of a sentence, directed relation options, and aggregated relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.text import short_hash
from spanloom.operators.ner import ACCEPT, REVIEW

PAIRS_PER_SENTENCE = 15


def swap_placeholders(text: Column) -> Column:
    """Standalone A and B exchanged."""
    x = F.regexp_replace(text, r"(?<![\p{L}\p{N}_])A(?![\p{L}\p{N}_])", "\u0001")
    x = F.regexp_replace(x, r"(?<![\p{L}\p{N}_])B(?![\p{L}\p{N}_])", "A")
    return F.regexp_replace(x, "\u0001", "B")


def relation_options(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """pairs (.., type_a, type_b) by directed relation: forward where A is the source, reversed where B is.

    signatures (ordinal, relation, domain_kind, range_kind, text) is a schema's table, a few rows, so it is broadcast.
    """
    sig = F.broadcast(signatures)
    ahead = pairs.join(sig, (F.col("type_a") == F.col("domain_kind")) & (F.col("type_b") == F.col("range_kind"))).withColumn("forward", F.lit(True))
    back = pairs.join(sig, (F.col("type_b") == F.col("domain_kind")) & (F.col("type_a") == F.col("range_kind"))).withColumn("forward", F.lit(False)).withColumn("text", swap_placeholders(F.col("text")))
    label = F.when(F.col("forward"), F.concat(F.lit("A_"), F.col("relation"), F.lit("_B"))).otherwise(F.concat(F.lit("B_"), F.col("relation"), F.lit("_A")))
    return ahead.unionByName(back).withColumn("label", label).drop("domain_kind", "range_kind")


def sentence_pairs(mentions: DataFrame, key: list[str], most: int = PAIRS_PER_SENTENCE, fits: Column | None = None) -> DataFrame:
    """Pairs of different entities of a sentence in order of their first mentions there, the first `most`; dropped: how many more.

    mentions: key (a sentence), entity, start and any type column named type. fits: a condition on the pair.
    """
    first = mentions.groupBy(*key, "entity").agg(F.min_by(F.struct("start", "type"), F.struct("start", "entity")).alias("f")).select(*key, "entity", "f.start", "f.type")
    if fits is None:
        # all kept pairs are among the first most + 1 entities, and a pair's place follows from its entities' places
        w = Window.partitionBy(*key)
        near = first.withColumn("i", F.row_number().over(w.orderBy("start", "entity"))).withColumn("n", F.count("*").over(w)).where(F.col("i") <= most + 1)
        held = near.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("i", "entity", "type"))).alias("e"), F.max("n").alias("n"))
        held = held.select(*key, F.explode("e").alias("l"), "e", "n").select(*key, "l", "n", F.explode(F.filter("e", lambda r: r["i"] > F.col("l.i"))).alias("r"))
        i, n = F.col("l.i"), F.col("n")
        at = (i - 1) * n - F.floor(i * (i - 1) / 2) + F.col("r.i") - i
        dropped = F.greatest(F.floor(n * (n - 1) / 2) - most, F.lit(0))
        placed = held.select(*key, F.col("l.entity").alias("a"), F.col("l.type").alias("type_a"), F.col("r.entity").alias("b"), F.col("r.type").alias("type_b"), at.cast("int").alias("at"), dropped.cast("long").alias("dropped"))
        return placed.where(F.col("at") <= most)
    a = first.select(*key, F.col("entity").alias("a"), F.col("start").alias("a_at"), F.col("type").alias("type_a"))
    b = first.select(*key, F.col("entity").alias("b"), F.col("start").alias("b_at"), F.col("type").alias("type_b"))
    pairs = a.join(b, key).where("struct(a_at, a) < struct(b_at, b)")
    pairs = pairs.where(fits)
    w = Window.partitionBy(*key)
    ranked = pairs.withColumn("at", F.row_number().over(w.orderBy("a_at", "a", "b_at", "b"))).withColumn("dropped", F.greatest(F.count("*").over(w) - most, F.lit(0)))
    return ranked.where(F.col("at") <= most).drop("a_at", "b_at")


def classify(options: DataFrame, answers: DataFrame, review: float = REVIEW) -> DataFrame:
    """Chosen options as directed instances: the option's label must be one that was offered, likely enough.

    options: q_id, a, b, page (of A), label, relation, forward; answers: q_id, choice, p.
    """
    chosen = options.join(answers.where(F.col("p") >= review), "q_id").where("choice = label")
    source, target = F.when(F.col("forward"), F.col("a")).otherwise(F.col("b")), F.when(F.col("forward"), F.col("b")).otherwise(F.col("a"))
    return chosen.withColumn("source_id", source).withColumn("target_id", target).withColumnRenamed("p", "probability")


def aggregate_relations(instances: DataFrame, key: list[str] = [], accept: float = ACCEPT) -> DataFrame:  # noqa: B006
    """One relation for each source, type and target: count, greatest probability, needs_review, sorted evidence."""
    by = [*key, "source_id", "type", "target_id"]
    out = instances.groupBy(*by).agg(F.count("*").alias("count"), F.max("probability").alias("confidence"), F.array_sort(F.collect_list(F.struct("chunk_id", "sentence", "probability"))).alias("evidence"))
    return out.withColumn("needs_review", F.col("confidence") < accept).withColumn("relation_id", short_hash(F.concat_ws("|", "source_id", "type", "target_id")))
