"""Call-log analytics over events, orders and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators import answers, report
from spanloom.plans.base import load, registrar, rounded, sql_over, sql_values, values

QUERIES, ORACLE_SQL, register = registrar()

PRICES = [("m", 1.0, 2.0, None, None), ("mini", 0.25, 0.5, 0.1, None), ("mini-2", 0.3, 0.75, 0.05, 0.4)]
PRICE_DDL = "model string, input double, output double, cache_read double, cache_write double"
MODELS = ("mini-2-a", "mini", "mx", "other")

#: Events read as calls: the type is the stage, the value the latency, k of props the number of questions.
CALLS_SQL = """
    SELECT event_type AS stage, CASE user_id % 4 WHEN 0 THEN 'mini-2-a' WHEN 1 THEN 'mini' WHEN 2 THEN 'mx' ELSE {last} END AS model,
           value AS latency_ms, k AS question_count, k * 700 + 13 AS input_tokens, k * 11 AS output_tokens, event_id % 3 * 100 AS cache_read_tokens, event_id % 5 AS cache_write_tokens,
           k * 90 AS request_bytes, k * 40 AS response_bytes, 1 + event_id % 3 AS attempts, CASE WHEN event_id % 17 = 0 THEN 429 ELSE 200 END AS status,
           event_id % 10 = 0 AS cached, CASE WHEN event_id % 23 = 0 THEN 'timeout' END AS error, user_id, event_id
    FROM (SELECT *, CAST({k} AS BIGINT) AS k FROM events)"""


def calls_of(spark, sf_dir, last="mini"):
    df = sql_over(spark, sf_dir, CALLS_SQL.format(k="get_json_object(props, '$.k')", last=f"'{last}'"), "events")
    return df.withColumn("status_codes", F.array(F.col("status").cast("int")))


def calls_sql(last="mini"):
    return CALLS_SQL.format(k="json_extract_string(props, '$.k')", last=f"'{last}'")


STATS_SQL = """
    WITH calls AS ({calls}), price(pm, input, output, cache_read, cache_write) AS (VALUES {prices}),
    priced AS (
        SELECT c.*, p.* FROM calls c LEFT JOIN (
            SELECT m.model AS pmodel, price.*, row_number() OVER (PARTITION BY m.model ORDER BY length(pm) DESC) AS rn
            FROM (SELECT DISTINCT model FROM calls) m JOIN price ON starts_with(m.model, pm)) p ON c.model = p.pmodel AND p.rn = 1),
    live AS (
        SELECT *, CASE WHEN input IS NULL THEN NULL ELSE (input_tokens * input + output_tokens * output + cache_read_tokens * coalesce(cache_read, input) + cache_write_tokens * coalesce(cache_write, input)) / 1e6 END AS cost
        FROM priced WHERE NOT cached)
    SELECT {by}, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
           min(input_tokens) AS min_input, round(quantile_cont(input_tokens, 0.5), 6) AS median_input, max(input_tokens) AS max_input,
           round(quantile_cont(latency_ms, 0.5), 6) AS p50_latency, round(quantile_cont(latency_ms, 0.95), 6) AS p95_latency,
           CAST(sum(request_bytes + response_bytes) AS BIGINT) AS bytes, round(quantile_cont(question_count, 0.5), 6) AS median_questions,
           CAST(sum(CASE WHEN attempts > 1 THEN 1 ELSE 0 END) AS BIGINT) AS retried, CAST(sum(CASE WHEN status = 429 THEN 1 ELSE 0 END) AS BIGINT) AS limited,
           CAST(sum(CASE WHEN error IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS failed,
           round(CASE WHEN count(*) FILTER (cost IS NULL) > 0 THEN NULL ELSE sum(cost) END, 6) AS cost, round(quantile_cont(cost, 0.5), 6) AS median_cost
    FROM live GROUP BY {by}"""


@register(STATS_SQL.format(calls=calls_sql(), prices=sql_values(PRICES), by="stage"))
def call_stats(spark, sf_dir):
    return rounded(report.call_stats(report.with_price(calls_of(spark, sf_dir), values(spark, PRICES, PRICE_DDL)), ["stage"]))


@register(STATS_SQL.format(calls=calls_sql("other"), prices=sql_values(PRICES), by="stage, model"))
def call_stats_null_cost(spark, sf_dir):
    return rounded(report.call_stats(report.with_price(calls_of(spark, sf_dir, "other"), values(spark, PRICES, PRICE_DDL)), ["stage", "model"]))


PREFIXES = [("PROMO", 1.0, 1.0, None, None), ("PROMO BRUSHED", 2.0, 1.0, None, None), ("STANDARD", 3.0, 1.0, None, None), ("S", 4.0, 1.0, None, None), ("ECONOMY ANODIZED", 5.0, 1.0, None, None)]


@register(f"""
    WITH price(pm, input, o, cr, cw) AS (VALUES {sql_values(PREFIXES)}), m AS (SELECT DISTINCT p_type FROM part),
    hit AS (SELECT p_type, pm, input, row_number() OVER (PARTITION BY p_type ORDER BY length(pm) DESC) AS rn FROM m JOIN price ON starts_with(p_type, pm))
    SELECT p_partkey, pm AS price_model, input FROM part LEFT JOIN (SELECT * FROM hit WHERE rn = 1) h USING (p_type)""")
def longest_prefix_price(spark, sf_dir):
    return report.with_price(load(spark, sf_dir, "part"), values(spark, PREFIXES, PRICE_DDL), "p_type").select("p_partkey", "price_model", "input")


@register(f"""
    WITH calls AS ({calls_sql("other")}), price(pm, a, b, c, d) AS (VALUES {sql_values(PRICES)})
    SELECT DISTINCT model FROM calls WHERE NOT cached AND NOT EXISTS (SELECT 1 FROM price WHERE starts_with(model, pm))""")
def unpriced_models(spark, sf_dir):
    return report.unpriced(calls_of(spark, sf_dir, "other"), values(spark, PRICES, PRICE_DDL))


#: Orders read as runs (priority: variant, customer modulo 50: document), lines as their calls (return flag: stage).
RUNS_SQL = """
    SELECT o_orderpriority AS variant, o_custkey % 50 AS doc_id, o_orderkey AS run_id, count(*) AS pages, sum(l_quantity) * 100 AS wall_ms, CAST(sum(l_partkey) AS BIGINT) AS bytes,
           CASE WHEN sum(CASE WHEN l_discount > 0.095 THEN 1 ELSE 0 END) > 0 THEN NULL ELSE sum(l_extendedprice) / 1e6 END AS cost
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL"""


def runs_of(spark, sf_dir):
    return sql_over(spark, sf_dir, RUNS_SQL, "orders", "lineitem")


@register(f"""
    SELECT variant, doc_id, count(*) AS reps, round(avg(wall_ms), 6) AS wall_mean, round(min(wall_ms), 6) AS wall_min, round(max(wall_ms), 6) AS wall_max,
           round(sum(pages) / (sum(wall_ms) / 60000), 6) AS pages_per_min, round(CASE WHEN count(*) > count(cost) THEN NULL ELSE avg(cost) END, 6) AS cost, round(sum(bytes) / count(*) / 1024, 6) AS payload_kib
    FROM ({RUNS_SQL}) GROUP BY variant, doc_id""")
def group_runs_report(spark, sf_dir):
    return rounded(report.group_runs(runs_of(spark, sf_dir)))


STAGE_CALLS = "SELECT o_orderpriority AS variant, o_custkey % 50 AS doc_id, o_orderkey AS run_id, l_returnflag AS stage, l_suppkey AS input_tokens, l_partkey AS bytes FROM orders JOIN lineitem ON o_orderkey = l_orderkey"
STAGE_SQL = """
    WITH c AS ({calls}), s AS (SELECT variant, doc_id, stage, count(*) AS n, sum(input_tokens) AS t, sum(bytes) AS b, count(DISTINCT run_id) AS own FROM c GROUP BY ALL),
    g AS (SELECT variant, doc_id, count(DISTINCT run_id) AS every FROM c GROUP BY ALL)
    SELECT variant, doc_id, stage, {runs} AS runs, round(n / {runs}, 6) AS calls_per_run, round(t / {runs}, 6) AS tokens_per_run, round(CASE WHEN t > 0 THEN b / t END, 6) AS bytes_per_token FROM s JOIN g USING (variant, doc_id)"""


def stage_calls(spark, sf_dir):
    return sql_over(spark, sf_dir, STAGE_CALLS, "orders", "lineitem")


@register(STAGE_SQL.format(calls=STAGE_CALLS, runs="own"))
def stage_report(spark, sf_dir):
    return rounded(report.stage_report(stage_calls(spark, sf_dir)))


@register(STAGE_SQL.format(calls=STAGE_CALLS, runs="every"))
def dashboard_stages(spark, sf_dir):
    return rounded(report.stage_report(stage_calls(spark, sf_dir), all_runs=True))


@register("""
    SELECT o_orderpriority AS variant, o_custkey, o_orderkey, o_totalprice FROM (
        SELECT *, row_number() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def first_run_per_group(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("variant"), "o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return report.first_run(orders, ["variant", "o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@register("""
    SELECT s_suppkey, round(entities / pages, 6) AS entities_per_page, round(relations / pages, 6) AS relations_per_page,
           round(CASE WHEN entities > 0 THEN cost / entities END, 6) AS cost_per_entity, round(CASE WHEN relations > 0 THEN cost / relations END, 6) AS cost_per_relation
    FROM (SELECT l_suppkey AS s_suppkey, count(*) AS pages, count(DISTINCT l_partkey) AS entities, count(*) FILTER (l_returnflag = 'R') AS relations, sum(l_extendedprice) AS cost FROM lineitem GROUP BY 1)""")
def yield_rows(spark, sf_dir):
    runs = load(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("pages"), F.countDistinct("l_partkey").alias("entities"), F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("relations"), F.sum("l_extendedprice").alias("cost"))
    return rounded(report.yields(runs).select("s_suppkey", "entities_per_page", "relations_per_page", "cost_per_entity", "cost_per_relation"))


@register("""
    WITH RECURSIVE r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, 1000 * (1 + event_id % 7) AS tokens, event_id * 37 % 1000000 AS now FROM events),
    s AS (SELECT user_id, i, tokens, CAST(now AS DOUBLE) AS start FROM r WHERE i = 1
          UNION ALL SELECT r.user_id, r.i, r.tokens, greatest(CAST(r.now AS DOUBLE), s.start + s.tokens / 200.0) FROM s JOIN r ON r.user_id = s.user_id AND r.i = s.i + 1)
    SELECT user_id, i AS n, round(start, 6) AS start_ms FROM s""")
def pacer_starts(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long")
    r = e.select("user_id", at.alias("at"), (F.lit(1000) * (1 + F.col("event_id") % 7)).alias("tokens"), (F.col("event_id") * 37 % 1000000).cast("double").alias("now_ms"))
    return report.pacer(r, ["user_id"]).select("user_id", F.col("at").alias("n"), F.round("start_ms", 6).alias("start_ms"))


@register(f"""
    WITH c AS ({calls_sql()}), size AS (SELECT stage, CAST(least(200, greatest(10, floor(48000 / max(input_tokens / question_count)))) AS INTEGER) AS batch FROM c WHERE question_count > 0 GROUP BY stage)
    SELECT event_id, c.stage, CAST(floor((row_number() OVER (PARTITION BY c.stage, user_id % 20 ORDER BY event_id) - 1) / coalesce(batch, 40)) AS INTEGER) AS batch_no FROM c LEFT JOIN size USING (stage)""")
def batching(spark, sf_dir):
    calls = calls_of(spark, sf_dir).withColumn("doc", F.col("user_id") % 20)
    return answers.batches(calls, answers.batch_size(calls), ["stage", "doc"], "event_id").select("event_id", "stage", "batch_no")


KEY = "sha256(coalesce(role, '') || '|' || coalesce(text, ''))"


@register(f"""
    WITH k AS (SELECT conv_id, turn, {KEY} AS cache_key FROM conversations), c AS (SELECT DISTINCT cache_key FROM k WHERE conv_id % 2 = 0)
    SELECT k.conv_id, k.turn, substr(k.cache_key, 1, 16) AS cache_key, c.cache_key IS NOT NULL AS hit FROM k LEFT JOIN c USING (cache_key)""")
def cache_probe(spark, sf_dir):
    turns = load(spark, sf_dir, "conversations")
    keyed = turns.select("conv_id", "turn", F.sha2(F.concat_ws("|", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))), 256).alias("cache_key"))
    hits, misses = answers.cache_probe(keyed, keyed.where("conv_id % 2 = 0").select("cache_key"))
    both = hits.withColumn("hit", F.lit(True)).unionByName(misses.withColumn("hit", F.lit(False)))
    return both.select("conv_id", "turn", F.substring("cache_key", 1, 16).alias("cache_key"), "hit")
