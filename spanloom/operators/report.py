"""Analytics of the call log: prices, costs, percentiles and grouped reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The pipeline's stages in order; the judge is apart.
STAGES = ("ner_tag", "ner_resolve", "ner_type", "entity_align", "relation")
LIMITED = (429, 529)


def with_price(calls: DataFrame, prices: DataFrame, model: str = "model") -> DataFrame:
    """calls with the columns of the price whose model is the longest prefix of theirs (itself first), or nulls.

    Models are few: prices are matched with the distinct models, and calls meet the result in a
    broadcast join, so calls are never shuffled or multiplied.
    """
    p = prices.withColumnRenamed("model", "price_model")
    models = calls.select(F.col(model).alias("_model")).distinct()
    hit = models.join(F.broadcast(p), F.col("_model").startswith(F.col("price_model")))
    best = hit.groupBy("_model").agg(F.max_by(F.struct(*p.columns), F.length("price_model")).alias("p")).select("_model", "p.*")
    return calls.join(F.broadcast(best), F.col(model) == F.col("_model"), "left").drop("_model")


def cost() -> Column:
    """0 for cached calls; null without a price or input tokens; cache tokens without a rate cost the input rate. Rates are per million."""
    rate = lambda tokens, r: F.coalesce(F.col(tokens), F.lit(0)) * r
    paid = rate("input_tokens", F.col("input")) + rate("output_tokens", F.col("output")) + rate("cache_read_tokens", F.coalesce("cache_read", "input")) + rate("cache_write_tokens", F.coalesce("cache_write", "input"))
    return F.when(F.col("cached"), 0.0).when(F.col("input").isNull() | F.col("input_tokens").isNull(), F.lit(None)).otherwise(paid / 1e6)


def null_if_any_null(total: Column, value: str) -> Column:
    return F.when(F.count(F.when(F.col(value).isNull(), 1)) > 0, F.lit(None)).otherwise(total)


def call_stats(calls: DataFrame, by: list[str]) -> DataFrame:
    """Statistics of priced calls, cached ones left out; percentiles interpolate linearly; one unpriced call makes a group's cost unknown."""
    live = calls.where("not cached").withColumn("cost", cost())
    q = lambda c, x, name: F.percentile(c, x).alias(name)
    return live.groupBy(*by).agg(
        F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.min("input_tokens").alias("min_input"), q("input_tokens", 0.5, "median_input"), F.max("input_tokens").alias("max_input"),
        q("latency_ms", 0.5, "p50_latency"), q("latency_ms", 0.95, "p95_latency"), F.sum(F.col("request_bytes") + F.col("response_bytes")).alias("bytes"),
        q("question_count", 0.5, "median_questions"), F.sum((F.col("attempts") > 1).cast("int")).alias("retried"),
        F.sum(F.exists("status_codes", lambda s: s.isin(*LIMITED)).cast("int")).alias("limited"), F.sum(F.col("error").isNotNull().cast("int")).alias("failed"),
        null_if_any_null(F.sum("cost"), "cost").alias("cost"), q("cost", 0.5, "median_cost"),
    )


def group_runs(runs: DataFrame) -> DataFrame:
    """runs (variant, doc_id, run_id, pages, wall_ms, bytes, cost) to one row a variant and document: means over repetitions."""
    return runs.groupBy("variant", "doc_id").agg(
        F.count("*").alias("reps"), F.avg("wall_ms").alias("wall_mean"), F.min("wall_ms").alias("wall_min"), F.max("wall_ms").alias("wall_max"),
        (F.sum("pages") / (F.sum("wall_ms") / 60000)).alias("pages_per_min"), null_if_any_null(F.avg("cost"), "cost").alias("cost"), (F.sum("bytes") / F.count("*") / 1024).alias("payload_kib"),
    )


def stage_report(calls: DataFrame, all_runs: bool = False) -> DataFrame:
    """Per variant, document and stage, per run: the report divides by the runs that have the stage, the dashboard (all_runs) by all of the group."""
    by = ["variant", "doc_id"]
    own = calls.groupBy(*by, "stage").agg(F.count("*").alias("n"), F.sum("input_tokens").alias("tokens"), F.sum("bytes").alias("bytes"), F.countDistinct("run_id").alias("runs"))
    if all_runs:
        own = own.drop("runs").join(calls.groupBy(*by).agg(F.countDistinct("run_id").alias("runs")), by)
    return own.select(*by, "stage", "runs", (F.col("n") / F.col("runs")).alias("calls_per_run"), (F.col("tokens") / F.col("runs")).alias("tokens_per_run"), F.when(F.col("tokens") > 0, F.col("bytes") / F.col("tokens")).alias("bytes_per_token"))


def first_run(runs: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each group, whole: one aggregate, no sort of the group."""
    others = [c for c in runs.columns if c not in by]
    return runs.groupBy(*by).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("r")).select(*by, "r.*")


def yields(runs: DataFrame) -> DataFrame:
    """runs (.., pages, entities, relations, cost) with figures per page and per thing found; null where there are none."""
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return runs.withColumns({"entities_per_page": over("entities", "pages"), "relations_per_page": over("relations", "pages"), "cost_per_entity": over("cost", "entities"), "cost_per_relation": over("cost", "relations")})


def unpriced(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Models of live calls that no price covers."""
    live = calls.where("not cached").select("model").distinct()
    return live.join(F.broadcast(prices.select(F.col("model").alias("price_model"))), F.col("model").startswith(F.col("price_model")), "left_anti")


def pacer(requests: DataFrame, by: list[str], tokens_per_second: float = 200_000) -> DataFrame:
    """requests (by, at, tokens, now_ms) with start_ms: start = max(now, previous start + tokens / rate).

    Unrolled: start_i = C_i + max over j <= i of (now_j - C_j), C the milliseconds of the tokens before i.
    """
    w = Window.partitionBy(*by).orderBy("at")
    before = F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * (1000.0 / tokens_per_second)
    return requests.withColumn("_c", before).withColumn("start_ms", F.col("_c") + F.max(F.col("now_ms") - F.col("_c")).over(w)).drop("_c")


def usd(x: Column) -> Column:
    return F.when(x.isNull(), "n/a").when(x < 0.01, F.format_string("$%.6f", x)).otherwise(F.format_string("$%.4f", x))


def pct(x: Column) -> Column:
    return F.when(x.isNull(), "n/a").otherwise(F.concat(F.format_string("%.1f", x * 100), F.lit("%")))


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small result as a table: reports have a row for each variant and document."""
    rows = df.limit(most).collect()
    out = ["| " + " | ".join(df.columns) + " |", "| " + " | ".join("---" for _ in df.columns) + " |"]
    return "\n".join(out + ["| " + " | ".join("n/a" if v is None else f"{v:,.4g}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows])


def dashboard(data: dict, template: str = '<!doctype html><script id="data" type="application/json">__DATA__</script>') -> str:
    """A page with the data inlined; `<` is escaped, so no string closes the script."""
    import json

    return template.replace("__DATA__", json.dumps(data).replace("<", "\\u003c"))
