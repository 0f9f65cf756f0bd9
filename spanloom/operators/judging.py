"""A judge's inputs, what its verdicts count for, and whether it may be trusted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.text import normalize_name
from spanloom.operators.evaluation import ratio

MOST_CLUSTERS, CLUSTER_CONTEXTS = 30, 4


def chunk_relations(relations: DataFrame) -> DataFrame:
    """(chunk_id, relation_id, ..) for each chunk that holds evidence of a relation (evidence: structs with chunk_id)."""
    return relations.withColumn("chunk_id", F.explode(F.array_distinct(F.transform("evidence", lambda e: e["chunk_id"]))))


def judged_mentions(mentions: DataFrame, order: str = "ord") -> DataFrame:
    """mentions with judged_id: m1, m2, .. in order within each chunk (of doc_id, chunk_id)."""
    at = F.row_number().over(Window.partitionBy("doc_id", "chunk_id").orderBy(order))
    return mentions.withColumn("judged_id", F.concat(F.lit("m"), at.cast("string")))


def judged_relations(relations: DataFrame, entities: DataFrame, order: str = "ord") -> DataFrame:
    """relations (doc_id, chunk_id, source_id, type, target_id, ..) with judged_id r1, r2, .. and the names and aliases of both
    ends; an end that is no known entity goes by its id and has no aliases."""
    none = F.array().cast("array<string>")
    out = relations
    for side in ("source", "target"):
        known = entities.select(F.col("entity_id").alias(f"{side}_id"), F.col("canonical_name").alias(f"_{side}"), F.col("aliases").alias(f"_{side}_aliases"))
        out = out.join(known, f"{side}_id", "left").withColumn(side, F.coalesce(f"_{side}", f"{side}_id")).withColumn(f"{side}_aliases", F.coalesce(f"_{side}_aliases", none)).drop(f"_{side}", f"_{side}_aliases")
    at = F.row_number().over(Window.partitionBy("doc_id", "chunk_id").orderBy(order))
    return out.withColumn("judged_id", F.concat(F.lit("r"), at.cast("string")))


def mention_verdicts(judged: DataFrame, verdicts: DataFrame) -> DataFrame:
    """judged mentions with their verdicts (doc_id, chunk_id, judged_id, is_entity, boundary_exact, type_correct); missing
    where there is none. What is no entity has neither a right boundary nor a right type."""
    found = verdicts.withColumn("_has", F.lit(True))
    rows = judged.join(found, ["doc_id", "chunk_id", "judged_id"], "left").withColumn("missing", F.col("_has").isNull()).drop("_has")
    return rows.withColumns({c: F.col("is_entity") & F.col(c) for c in ("boundary_exact", "type_correct")}).withColumn("accepted", F.col("status") == "accepted")


def relation_verdicts(judged: DataFrame, verdicts: DataFrame) -> DataFrame:
    """judged relations with their verdicts (.., supported, type_correct, direction_correct), likewise."""
    found = verdicts.withColumn("_has", F.lit(True))
    rows = judged.join(found, ["doc_id", "chunk_id", "judged_id"], "left").withColumn("missing", F.col("_has").isNull()).drop("_has")
    return rows.withColumns({c: F.col("supported") & F.col(c) for c in ("type_correct", "direction_correct")}).withColumn("accepted", ~F.col("needs_review"))


def missed_relations(misses: DataFrame, chunks: DataFrame, judged: DataFrame, known: Column) -> DataFrame:
    """misses (doc_id, chunk_id, miss_id, source_quote, relation, target_quote) with valid: both quotes are in the chunk's
    text, the relation is a known one, and no judged relation of the chunk joins these names, whatever the alias."""
    side = lambda s: F.transform(F.concat(F.array(s), f"{s}_aliases"), normalize_name)
    names = judged.select("doc_id", "chunk_id", F.col("type").alias("relation"), F.explode(side("source")).alias("_source"), side("target").alias("t"))
    names = names.select("doc_id", "chunk_id", "relation", "_source", F.explode("t").alias("_target")).distinct().withColumn("_there", F.lit(True))
    rows = misses.join(chunks.select("doc_id", "chunk_id", F.col("text").alias("_text")), ["doc_id", "chunk_id"], "left")
    rows = rows.withColumn("_source", normalize_name(F.col("source_quote"))).withColumn("_target", normalize_name(F.col("target_quote")))
    rows = rows.join(names, ["doc_id", "chunk_id", "relation", "_source", "_target"], "left")
    quoted = F.contains("_text", "source_quote") & F.contains("_text", "target_quote")
    return rows.withColumn("valid", F.coalesce(quoted & known & F.col("_there").isNull(), F.lit(False))).select(*misses.columns, "valid")


def merged_clusters(entities: DataFrame, most: int = MOST_CLUSTERS) -> DataFrame:
    """The first entities, in order, that have more than one normalized name: what cluster purity is judged on."""
    names = F.array_distinct(F.transform(F.concat(F.array("canonical_name"), "aliases"), normalize_name))
    return entities.where(F.size(names) > 1).orderBy("ord").limit(most)


def cluster_contexts(mentions: DataFrame, key: str = "entity_id", most: int = CLUSTER_CONTEXTS) -> DataFrame:
    """(key, contexts): up to four distinct sentences of an entity's mentions (key, ord, context), in order."""
    first = mentions.where("context is not null").groupBy(key, "context").agg(F.min("ord").alias("ord"))
    at = F.row_number().over(Window.partitionBy(key).orderBy("ord", "context"))
    return first.withColumn("at", at).where(F.col("at") <= most).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "context"))).alias("c")).select(key, F.transform("c", lambda c: c["context"]).alias("contexts"))


def run_counts(key: list[str], **tables: DataFrame) -> DataFrame:
    """key and the rows each table has of it (0 if none), one column a table: pages, chunks, tokens, mentions and so on."""
    parts = None
    for name, df in tables.items():
        one = df.select(*key, F.lit(name).alias("what"))
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy(*key).agg(*(F.count_if(F.col("what") == n).alias(n) for n in tables))


def judge_summary(chunks: DataFrame, mentions: DataFrame, relations: DataFrame, misses: DataFrame, by: list[str]) -> DataFrame:
    """by and: chunks judged and failed (error is not null), errors in order of the chunk, verdicts missing and misses discarded in chunks that didn't fail."""
    line = F.concat_ws(": ", "chunk_id", "error")
    per = chunks.groupBy(*by).agg(F.count_if(F.col("error").isNull()).alias("chunks_judged"), F.count_if(F.col("error").isNotNull()).alias("chunks_failed"), F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), line))).alias("errors"))
    fine = chunks.where("error is null").select(*by, "doc_id", "chunk_id")
    missing = mentions.select("doc_id", "chunk_id", "missing").unionByName(relations.select("doc_id", "chunk_id", "missing")).join(fine, ["doc_id", "chunk_id"]).groupBy(*by).agg(F.count_if("missing").alias("missing_verdicts"))
    dropped = misses.select("doc_id", "chunk_id", "valid").join(fine, ["doc_id", "chunk_id"]).groupBy(*by).agg(F.count_if(~F.col("valid")).alias("discarded_misses"))
    return per.join(missing, by, "left").join(dropped, by, "left").fillna(0, ["missing_verdicts", "discarded_misses"])


def check_cases(gold: DataFrame, kinds: list[str]) -> DataFrame:
    """What a judge is shown of each gold passage (ord, id, text, entities array<struct<text,type>>): (id, case, text, mentions).

    Cases: gold as labelled; shuffled, each type replaced by the next kind; foreign, the next passage's
    entities (the last one's are the first's; absent for a lone passage); empty, nothing. The window runs
    over a gold set, a hand-made file.
    """
    following = F.create_map(*(F.lit(x) for k, n in zip(kinds, kinds[1:] + kinds[:1], strict=True) for x in (k, n)))
    order = Window.partitionBy(F.lit(0)).orderBy("ord")
    rows = gold.withColumn("after", F.lead("entities").over(order)).withColumn("head", F.first("entities").over(order)).withColumn("n", F.count("*").over(Window.partitionBy(F.lit(0))))
    numbered = lambda es: F.transform(es, lambda e, i: F.struct(F.concat(F.lit("m"), (i + 1).cast("string")).alias("id"), e["text"].alias("text"), e["type"].alias("type")))
    shuffled = F.transform("entities", lambda e: F.struct(e["text"].alias("text"), F.coalesce(following[e["type"]], F.lit(kinds[0])).alias("type")))
    none = F.filter(numbered(F.col("entities")), lambda e: F.lit(False))
    cases = [("gold", numbered(F.col("entities"))), ("shuffled", numbered(shuffled)), ("foreign", F.when(F.col("n") > 1, numbered(F.coalesce("after", "head")))), ("empty", none)]
    table = F.array(*(F.struct(F.lit(c).alias("case"), m.alias("mentions")) for c, m in cases))
    return rows.select("id", "text", F.explode(table).alias("c")).select("id", "c.case", "text", "c.mentions").where("mentions is not null")


def check_rates(cases: DataFrame, verdicts: DataFrame, missed: DataFrame) -> DataFrame:
    """One row: counts and rates of a judge's verdicts (id, case, judged_id, is_entity, boundary_exact, type_correct) on
    check_cases, and of the entities it found itself in the empty case (missed: id, quote).

    gold: right in all three; shuffled: type called wrong; foreign: called no entity, of those that the
    passage doesn't hold; empty: quoted, as names compare.
    """
    shown = cases.select("id", "case", "text", F.explode("mentions").alias("m")).select("id", "case", "text", F.col("m.id").alias("judged_id"), F.col("m.text").alias("name"))
    rows = shown.join(verdicts, ["id", "case", "judged_id"], "left")
    of = lambda c, x: F.count_if((F.col("case") == c) & F.coalesce(x, F.lit(False)))
    absent = ~F.contains("text", "name")
    every = F.lit(True)
    counts = rows.agg(
        of("gold", F.col("is_entity") & F.col("boundary_exact") & F.col("type_correct")).alias("agreed"), of("gold", F.col("is_entity").isNotNull()).alias("total"),
        of("shuffled", ~F.col("type_correct")).alias("shuffled"), of("shuffled", every).alias("shuffled_total"),
        of("foreign", absent & ~F.col("is_entity")).alias("foreign"), of("foreign", absent).alias("foreign_total"),
    )
    quoted = missed.select("id", normalize_name(F.col("quote")).alias("name")).distinct().withColumn("hit", F.lit(True))
    own = shown.where("case = 'gold'").select("id", normalize_name(F.col("name")).alias("name")).join(quoted, ["id", "name"], "left")
    found = own.agg(F.count("hit").alias("found"), F.count("*").alias("found_total"))
    both = counts.crossJoin(found)  # one row each
    return both.select("*", ratio(F.col("agreed"), F.col("total")).alias("gold"), ratio(F.col("shuffled"), F.col("shuffled_total")).alias("shuffled_rate"), ratio(F.col("foreign"), F.col("foreign_total")).alias("foreign_rate"), ratio(F.col("found"), F.col("found_total")).alias("empty"))
