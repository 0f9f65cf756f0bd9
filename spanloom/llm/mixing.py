"""Mixing sources to target weights by temperature, in DataFrame functions only.

Source s has the share p_s of all tokens; its weight is p_s^t / sum p^t. At t = 1 weights are the
natural shares, at t = 0 all sources weigh the same. The exponent t is bisected until the weights
have the target entropy, then raised, if it must be, until no source is repeated more often than
the limit. Each source's tokens are a fixed share of the budget: so many full passes over the source
and a part of one more. Documents lie in hash blocks; each pass takes the blocks in a permuted order of
its own and the documents of a block in a permuted order, and the last pass stops as soon as its budget
is spent. A row's position is its place in that order: the documents of the blocks before, and those
before it in its block. Documents are shuffled once, by block, which no source can make large.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import cut

#: Where between the natural entropy (0) and that of equal weights (1) the target lies.
FLATTEN, MAX_REPEATS = 0.5, 4.0
BLOCK_DOCS = 512
BROADCAST_SOURCES = 20_000


def tokens_of(text: Column) -> Column:
    """White-space separated words."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def moments(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """(entropy, largest weight over share) at each exponent; one job, one row a partition and exponent."""
    lp, t = F.log("p"), F.explode(F.array(*map(F.lit, exponents))).alias("t")
    at = shares.select(F.col("p"), lp.alias("lp"), t).withColumn("x", F.exp(F.col("t") * F.col("lp")))
    sums = at.groupBy("t").agg(F.sum("x").alias("z"), F.sum(F.col("x") * F.col("lp")).alias("s"), F.max(F.col("x") / F.col("p")).alias("r")).collect()
    found = {r["t"]: (math.log(r["z"]) - r["t"] * r["s"] / r["z"], r["r"] / r["z"]) for r in sums}
    return [found[t] for t in exponents]


def bisect(shares: DataFrame, holds, lo: float = 0.0, hi: float = 1.0, rounds: int = 8, levels: int = 5) -> float:
    """The smallest exponent in [lo, hi] for which holds(moments), true from there on, is true; hi if never.

    Each job settles `levels` halvings at once by looking at all their possible midpoints.
    """
    for _ in range(rounds):
        n = 1 << levels
        inner = [lo + (hi - lo) * i / n for i in range(1, n)]
        true = [t for t, m in zip(inner, moments(shares, inner), strict=True) if holds(m)]
        at = min(true, default=hi)
        lo, hi = at - (hi - lo) / n, at
    return hi


def plan_sources(docs: DataFrame, flatten: float = FLATTEN, max_repeats: float = MAX_REPEATS, budget_tokens: int | None = None, block_docs: int = BLOCK_DOCS) -> tuple[DataFrame, float]:
    """(source, tokens, weight, blocks, passes, rest) for each source, and the exponent.

    docs: source, tokens. passes: full ones; rest: tokens for the pass after them. Sources without a
    token have the weight 0 and one full pass.
    """
    per = cut(docs.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")))
    total, sources = per.where("tokens > 0").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count("*")).first()
    shares = cut(per.where("tokens > 0").select("source", (F.col("tokens") / F.lit(float(max(total, 1)))).alias("p")))
    budget = total if budget_tokens is None else budget_tokens
    exponent, z = 1.0, 1.0
    if sources:
        natural = moments(shares, [1.0])[0][0]
        target = natural + flatten * (math.log(sources) - natural)
        exponent = 0.0 if flatten >= 1 else bisect(shares, lambda m: m[0] <= target) if flatten > 0 else 1.0
        if moments(shares, [exponent])[0][1] * budget / total > max_repeats:
            exponent = bisect(shares, lambda m: m[1] * budget / total <= max_repeats, exponent)
        z = shares.agg(F.sum(F.exp(F.lit(exponent) * F.log("p")))).first()[0]
    p = F.col("tokens") / F.lit(float(max(total, 1)))
    weight = F.when(F.col("tokens") > 0, F.exp(F.lit(exponent) * F.log(p)) / z).otherwise(0.0)
    plan = per.withColumn("weight", weight).withColumn("goal", F.floor(F.col("weight") * float(budget) + 0.5).cast("long"))
    plan = plan.withColumn("blocks", F.ceil(F.col("docs") / block_docs).cast("long"))
    plan = plan.withColumn("passes", F.when(F.col("tokens") > 0, F.floor(F.col("goal") / F.col("tokens"))).otherwise(1).cast("int"))
    return plan.withColumn("rest", F.col("goal") - F.col("passes") * F.col("tokens")).select("source", "tokens", "weight", "blocks", "passes", F.when(F.col("tokens") > 0, F.col("rest")).otherwise(0).alias("rest")), exponent


def with_plan(rows: DataFrame, plan: DataFrame, sources: int) -> DataFrame:
    """rows joined with their source's plan: broadcast while that is small, else a join that Spark may split where it is skewed."""
    return rows.join(F.broadcast(plan) if sources <= BROADCAST_SOURCES else plan, "source")


def mix(docs: DataFrame, flatten: float = FLATTEN, max_repeats: float = MAX_REPEATS, budget_tokens: int | None = None, block_docs: int = BLOCK_DOCS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs, each row as often as the mixture takes it, with _epoch, _position (from 0, without gaps, in each
    source and epoch), _block, _tokens, _weight, _exponent (which replace columns of these names; no other
    name matters).

    budget_tokens: of the mixture; as many as docs has, unless given. A source gets its share to
    within one document. A null source is a source of its own; null and blank texts have no tokens
    and come along with each full pass, and with the last one as their place has it. Rows that repeat
    id and text lie side by side in every pass and are taken or left together; ties go by a hash of both.
    """
    key = F.xxhash64(docs[id_col], docs[text_col], F.lit("mix"))
    whole = F.struct(*(docs[c] for c in docs.columns)).alias("_row")  # so that no column's name can clash
    rows = docs.select(whole, F.coalesce(docs[source_col].cast("string"), F.lit("\0")).alias("_source"), tokens_of(docs[text_col].cast("string")).alias("_tokens"), key.alias("_key"))
    light = cut(rows.select(F.col("_source").alias("source"), F.col("_tokens").alias("tokens"), F.col("_key").alias("key")))
    plan, exponent = plan_sources(light, flatten, max_repeats, budget_tokens, block_docs)
    plan = cut(plan)
    sources = plan.count()
    block = F.pmod("key", "blocks")
    # the last pass: whole blocks in permuted order, then the documents of the block where its budget ends
    placed = with_plan(light, plan.select("source", "blocks", "passes", "rest"), sources).withColumn("block", block)
    sums = placed.groupBy("source", "block").agg(F.sum("tokens").alias("n"), F.count("*").alias("docs"), F.first("rest").alias("rest"), F.first("passes").alias("passes")).withColumn("order", block_order("source", "block", "passes"))
    sums = cut(sums)
    # one row for block_docs documents of the source
    before = Window.partitionBy("source").orderBy("order", "block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    taken = sums.where("before < rest")
    last = taken.groupBy("source").agg(F.max(F.struct("order", "block", "before")).alias("last"))
    last = last.select("source", F.col("last.order").alias("last_order"), F.col("last.block").alias("last_block"), F.col("last.before").alias("before"))
    edge = with_plan(placed, last, sources).where("block = last_block").withColumn("place", F.xxhash64("key", "passes"))
    inside = Window.partitionBy("source", "block").orderBy("place", "key").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("so_far", F.col("before") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))).where("so_far < rest")
    stop = edge.groupBy("source").agg(F.max("place").alias("last_place"))
    full = cut(plan.join(last.drop("before"), "source", "left").join(stop, "source", "left").select(F.col("source").alias("_source"), F.struct("blocks", "passes", "weight", "last_order", "last_block", "last_place").alias("_plan")))
    # documents of a pass that come before a block, for each pass
    passes = sums.withColumn("epoch", F.explode(F.sequence(F.lit(0), "passes"))).withColumn("order", block_order("source", "block", "epoch"))
    ahead = Window.partitionBy("source", "epoch").orderBy("order", "block").rowsBetween(Window.unboundedPreceding, -1)
    passes = passes.withColumn("ahead", F.coalesce(F.sum("docs").over(ahead), F.lit(0)))
    passes = passes.groupBy("source", "block").agg(F.map_from_entries(F.collect_list(F.struct("epoch", "ahead"))).alias("_ahead"))
    passes = passes.select(F.col("source").alias("_source"), F.col("block").alias("_block"), "_ahead")
    joined = rows.join(F.broadcast(full) if sources <= BROADCAST_SOURCES else full, "_source")
    joined = joined.withColumn("_block", F.pmod("_key", "_plan.blocks")).join(passes, ["_source", "_block"])
    order = block_order("_source", "_block", "_plan.passes")
    in_rest = (order < F.col("_plan.last_order")) | ((F.col("_block") == F.col("_plan.last_block")) & (F.xxhash64("_key", "_plan.passes") <= F.col("_plan.last_place")))
    copies = F.col("_plan.passes") + F.coalesce(in_rest, F.lit(False)).cast("int")
    out = joined.withColumn("_epoch", F.explode(F.when(copies > 0, F.sequence(F.lit(0), copies - 1)).otherwise(F.array().cast("array<int>"))))
    inside = Window.partitionBy("_source", "_block", "_epoch").orderBy(F.xxhash64("_key", "_epoch"), "_key")
    position = (F.element_at("_ahead", F.col("_epoch")) + F.row_number().over(inside) - 1).cast("long")
    out = out.withColumn("_position", position)
    added = {"_epoch": F.col("_epoch"), "_position": F.col("_position"), "_block": F.col("_block"), "_tokens": F.col("_tokens"), "_weight": F.col("_plan.weight"), "_exponent": F.lit(exponent)}
    return out.select(*(F.col(f"_row.`{c}`") for c in docs.columns if c not in added), *(x.alias(c) for c, x in added.items()))


def block_order(source: str, block: str, epoch: str) -> Column:
    return F.xxhash64(source, block, epoch, F.lit("block"))
