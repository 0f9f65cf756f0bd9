"""Metrics over labels, documents and lines read as verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators import evaluation as E
from spanloom.plans.base import load, registrar, rounded, sql_over

QUERIES, ORACLE_SQL, register = registrar()

#: Lines read as mention verdicts by the order's supplier modulo 7.
VERDICTS = "SELECT l_suppkey % 7 AS grp, l_orderkey AS item, l_partkey * 10 + l_linenumber AS ord, l_tax <= 0.06 AS accepted, l_returnflag <> 'R' AS is_entity, l_linestatus = 'O' AS boundary_exact, l_quantity > 10 AS type_correct, l_discount * 10 AS confidence FROM lineitem"
PRF = "round({tp} / nullif({tp} + {fp}, 0), 6) AS precision, round({tp} / nullif({tp} + {fn}, 0), 6) AS recall, round(CASE WHEN {tp} > 0 THEN 2 * {tp} / (2 * {tp} + {fp} + {fn}) END, 6) AS f1"
COUNTS = "WITH v AS ({v}), c AS (SELECT grp, count(*) FILTER (accepted AND ok) AS tp, count(*) FILTER (accepted AND NOT ok) AS fp, count(*) FILTER (is_entity AND accepted AND NOT ok) + count(*) FILTER (is_entity AND NOT accepted) + 3 AS fn FROM (SELECT *, {ok} AS ok FROM v) GROUP BY grp) SELECT grp, tp, fp, fn, {prf} FROM c"
PRF3 = PRF.format(tp="tp", fp="fp", fn="fn")


def verdicts(spark, sf_dir):
    return sql_over(spark, sf_dir, VERDICTS, "lineitem")


@register(COUNTS.format(v=VERDICTS, ok="is_entity AND boundary_exact AND type_correct", prf=PRF3))
def entity_metrics(spark, sf_dir):
    return rounded(E.entity_metrics(E.forced(verdicts(spark, sf_dir)), 3, ["grp"]))


@register(COUNTS.format(v=VERDICTS, ok="is_entity AND type_correct", prf=PRF3))
def entity_metrics_relaxed(spark, sf_dir):
    return rounded(E.entity_metrics(E.forced(verdicts(spark, sf_dir)), 3, ["grp"], E.relaxed_correct()))


@register(f"SELECT grp, round(avg(CASE WHEN type_correct THEN 1.0 ELSE 0.0 END), 6) AS type_accuracy FROM ({VERDICTS}) WHERE accepted AND is_entity GROUP BY grp")
def type_accuracy(spark, sf_dir):
    return rounded(E.type_accuracy(E.forced(verdicts(spark, sf_dir)), ["grp"]))


@register(f"""
    WITH v AS ({VERDICTS}), r AS (SELECT grp, item, bool_or(is_entity AND type_correct AND boundary_exact) AS correct, bool_or(is_entity) AS supported, arg_min(accepted, ord) AS accepted FROM v GROUP BY ALL),
    c AS (SELECT grp, count(*) FILTER (accepted AND correct) AS tp, count(*) FILTER (accepted AND NOT correct) AS fp, count(*) FILTER (supported AND NOT (accepted AND correct)) + 2 AS fn FROM r GROUP BY grp)
    SELECT grp, tp, fp, fn, {PRF3} FROM c""")
def relation_metrics(spark, sf_dir):
    v = verdicts(spark, sf_dir).select("grp", F.col("item").alias("relation_id"), "ord", "accepted", F.col("is_entity").alias("supported"), "type_correct", F.col("boundary_exact").alias("direction_correct"))
    return rounded(E.relation_metrics(v, 2, ["grp"]))


@register(f"""
    WITH c AS (SELECT source AS grp, count(*) FILTER (quality = 1 AND toxic = 0) AS tp, count(*) FILTER (quality = 1 AND toxic = 1) AS fp, count(*) FILTER (quality IS NULL) AS fn
               FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source)
    SELECT grp, tp, fp, fn, {PRF3} FROM c""")
def prf_metrics(spark, sf_dir):
    joined = load(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("grp")).join(load(spark, sf_dir, "labels"), "doc_id", "left")
    q = F.col("quality")
    c = joined.groupBy("grp").agg(E.count_if((q == 1) & (F.col("toxic") == 0)).alias("tp"), E.count_if((q == 1) & (F.col("toxic") == 1)).alias("fp"), E.count_if(q.isNull()).alias("fn"))
    return rounded(c.select("grp", "tp", "fp", "fn", *E.prf(F.col("tp"), F.col("fp"), F.col("fn"))))


ITEMS = "SELECT (n_chars % 1001) / 1000 AS confidence, quality = 1 AS correct FROM documents JOIN labels USING (doc_id)"
BINS = f"SELECT CAST(least(floor(confidence * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(confidence) AS mean_confidence, avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) AS accuracy FROM ({ITEMS}) GROUP BY 1"


def items(spark, sf_dir):
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    return docs.select("doc_id", "n_chars").join(labels, "doc_id").select((F.col("n_chars") % 1001 / 1000).alias("confidence"), (F.col("quality") == 1).alias("correct"))


@register(f"SELECT bin, n, round(mean_confidence, 6) AS mean_confidence, round(accuracy, 6) AS accuracy FROM ({BINS})")
def calibration_bins(spark, sf_dir):
    return rounded(E.calibration_bins(items(spark, sf_dir)))


@register(f"SELECT round(sum(n * abs(accuracy - mean_confidence)) / sum(n), 6) AS ece FROM ({BINS})")
def ece(spark, sf_dir):
    return rounded(E.expected_calibration_error(E.calibration_bins(items(spark, sf_dir))))


@register("""
    WITH p AS (SELECT a.quality AS q1, b.quality AS q2, a.toxic AS t1, b.toxic AS t2 FROM labels a JOIN labels b ON b.doc_id = a.doc_id + 1),
    x AS (SELECT q1 = q2 AS s FROM p UNION ALL SELECT t1 = t2 FROM p)
    SELECT count(*) AS compared, count(*) FILTER (s) AS same, round(count(*) FILTER (s) / nullif(count(*), 0), 6) AS agreement FROM x""")
def verdict_agreement(spark, sf_dir):
    labels = load(spark, sf_dir, "labels")
    return rounded(E.verdict_agreement(labels, labels.withColumn("doc_id", F.col("doc_id") - 1), "doc_id", ["quality", "toxic"]))


@register(f"""
    WITH p AS (SELECT DISTINCT l_suppkey % 5 AS grp, l_partkey AS k FROM lineitem WHERE l_returnflag = 'A'), g AS (SELECT DISTINCT l_suppkey % 5 AS grp, l_partkey AS k FROM lineitem WHERE l_quantity < 20),
    c AS (SELECT coalesce(p.grp, g.grp) AS grp, count(*) FILTER (p.k IS NOT NULL AND g.k IS NOT NULL) AS tp, count(*) FILTER (g.k IS NULL) AS fp, count(*) FILTER (p.k IS NULL) AS fn
          FROM p FULL JOIN g ON p.grp = g.grp AND p.k = g.k GROUP BY 1) SELECT grp, tp, fp, fn, {PRF3} FROM c""")
def gold_diff(spark, sf_dir):
    l = load(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 5).alias("grp"), F.col("l_partkey").alias("k"), "l_returnflag", "l_quantity")
    return rounded(E.gold_counts(l.where("l_returnflag = 'A'"), l.where("l_quantity < 20"), ["grp"], ["k"]))


@register("""
    SELECT k, 'spurious' AS error FROM (SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity < 10)
    UNION ALL SELECT k, 'missed' FROM (SELECT l_partkey AS k FROM lineitem WHERE l_quantity < 10 EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')""")
def gold_errors(spark, sf_dir):
    l = load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), "l_returnflag", "l_quantity")
    return E.gold_errors(l.where("l_returnflag = 'A'"), l.where("l_quantity < 10"), ["k"])


@register(f"""
    WITH v AS ({VERDICTS}), c AS (SELECT grp, count(*) FILTER (accepted AND is_entity AND boundary_exact AND type_correct) AS tp,
        count(*) FILTER (accepted AND NOT (is_entity AND boundary_exact AND type_correct)) AS fp, count(*) FILTER (is_entity AND accepted AND NOT (boundary_exact AND type_correct)) + count(*) FILTER (is_entity AND NOT accepted) AS fn FROM v GROUP BY grp),
    s AS (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM c) SELECT tp, fp, fn, {PRF3} FROM s""")
def summed_scores(spark, sf_dir):
    return rounded(E.sum_scores(E.entity_metrics(E.forced(verdicts(spark, sf_dir)), 0, ["grp"])))


@register("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM documents) WHERE i % 3 = 0")
def sample_every_n(spark, sf_dir):
    return E.sample_every(load(spark, sf_dir, "documents").select("source", "doc_id"), 3, "doc_id", ["source"]).select("source", "doc_id")


@register("""
    WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents),
    k AS (SELECT *, greatest(1, floor(n * 0.1 + 0.5)) AS k FROM r), s AS (SELECT *, floor(n / k) AS step FROM k)
    SELECT source, doc_id FROM s WHERE i % step = 0 AND floor(i / step) < k""")
def repeat_sample(spark, sf_dir):
    return E.repeat_sample(load(spark, sf_dir, "documents").select("source", "doc_id"), "doc_id", ["source"]).select("source", "doc_id")


@register("""
    WITH q AS (SELECT doc_id, item_id AS quote_id, d.text AS text, b.text AS quote FROM documents d JOIN benchmark b ON contains(d.text, b.text)),
    m AS (SELECT doc_id AS m_doc, n_chars % 700 AS s, n_chars % 700 + 150 AS e FROM documents),
    o AS (SELECT doc_id, quote_id, quote, unnest(range(0, length(text) - length(quote) + 1)) AS pos, text FROM q),
    hit AS (SELECT doc_id, quote_id, pos, length(quote) AS n FROM o WHERE substr(text, CAST(pos + 1 AS BIGINT), length(quote)) = quote)
    SELECT doc_id, quote_id, CAST(min(pos) AS INTEGER) AS first_clear, count(*) AS clear FROM hit WHERE NOT EXISTS (SELECT 1 FROM m WHERE m_doc = doc_id AND pos < e AND pos + n > s) GROUP BY ALL""")
def verified_misses(spark, sf_dir):
    docs, bench = load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")
    quotes = E.quoted(docs.select("doc_id", "text"), bench.select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote")))
    mentions = docs.select("doc_id", (F.col("n_chars") % 700).alias("start"), (F.col("n_chars") % 700 + 150).alias("end"))
    return E.verified_misses(quotes, mentions)


@register("""
    SELECT count(*) FILTER (pure) AS pure, count(*) AS judged, round(count(*) FILTER (pure) / nullif(count(*), 0), 6) AS purity
    FROM (SELECT p_name, min(p_brand) = max(p_brand) AS pure FROM part GROUP BY p_name HAVING count(*) > 1)""")
def cluster_purity(spark, sf_dir):
    judged = load(spark, sf_dir, "part").groupBy("p_name").agg(F.count("*").alias("n"), (F.min("p_brand") == F.max("p_brand")).alias("pure")).where("n > 1")
    return rounded(E.cluster_purity(judged))


@register("""
    WITH r AS (SELECT source, avg(quality) AS gold, avg(1 - toxic) AS shuffled, CASE WHEN count(*) % 2 = 0 THEN avg(quality) END AS foreign_rate, 1.0 AS empty, CAST(sum(toxic) % 2 AS BIGINT) AS errors FROM documents JOIN labels USING (doc_id) GROUP BY source)
    SELECT source, gold >= 0.9 AND shuffled >= 0.9 AND coalesce(foreign_rate, 1) >= 0.9 AND empty >= 0.9 AND errors = 0 AS passes FROM r""")
def judge_check(spark, sf_dir):
    r = load(spark, sf_dir, "documents").select("doc_id", "source").join(load(spark, sf_dir, "labels"), "doc_id").groupBy("source").agg(
        F.avg("quality").alias("gold"), F.avg(1 - F.col("toxic")).alias("shuffled"), F.when(F.count("*") % 2 == 0, F.avg("quality")).alias("foreign_rate"), F.lit(1.0).alias("empty"), (F.sum("toxic") % 2).alias("errors"))
    return E.judge_passes(r).select("source", "passes")
