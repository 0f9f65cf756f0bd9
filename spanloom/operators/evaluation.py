"""Metrics over verdicts and gold sets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """precision, recall, f1; null where a denominator is 0."""
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).alias("f1")]


def count_if(x: Column) -> Column:
    return F.coalesce(F.sum(F.when(x, 1).otherwise(0)), F.lit(0)).cast("long")


def strict_correct() -> Column:
    return F.col("is_entity") & F.col("boundary_exact") & F.col("type_correct")


def relaxed_correct() -> Column:
    return F.col("is_entity") & F.col("type_correct")


def forced(verdicts: DataFrame) -> DataFrame:
    """Boundary and type can't be right for what isn't an entity."""
    return verdicts.withColumns({c: F.col("is_entity") & F.col(c) for c in ("boundary_exact", "type_correct")})


def entity_metrics(verdicts: DataFrame, missed: int, by: list[str], correct: Column | None = None) -> DataFrame:
    """tp: accepted and correct; fp: accepted and not; fn: missed, real but wrong, or real and held back for review."""
    right = strict_correct() if correct is None else correct
    counts = verdicts.groupBy(*by).agg(
        count_if(F.col("accepted") & right).alias("tp"), count_if(F.col("accepted") & ~right).alias("fp"),
        (count_if(F.col("is_entity") & F.col("accepted") & ~right) + count_if(F.col("is_entity") & ~F.col("accepted")) + missed).alias("fn"),
    )
    return counts.select(*by, "tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def type_accuracy(verdicts: DataFrame, by: list[str]) -> DataFrame:
    real = verdicts.where("accepted and is_entity")
    return real.groupBy(*by).agg(F.avg(F.col("type_correct").cast("int")).alias("type_accuracy"))


def relation_metrics(verdicts: DataFrame, missed: int, by: list[str]) -> DataFrame:
    """Verdicts of a relation count once: correct or supported if any is, accepted as its first one is."""
    right = F.col("supported") & F.col("type_correct") & F.col("direction_correct")
    one = verdicts.groupBy(*by, "relation_id").agg(F.bool_or(right).alias("correct"), F.bool_or("supported").alias("supported"), F.min_by("accepted", "ord").alias("accepted"))
    counts = one.groupBy(*by).agg(
        count_if(F.col("accepted") & F.col("correct")).alias("tp"), count_if(F.col("accepted") & ~F.col("correct")).alias("fp"),
        (count_if(F.col("supported") & ~(F.col("accepted") & F.col("correct"))) + missed).alias("fn"),
    )
    return counts.select(*by, "tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def calibration_bins(items: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, mean_confidence, accuracy) of items (confidence, correct); the last bin takes 1.0, empty bins don't come."""
    at = F.greatest(F.lit(0), F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1))).cast("int")
    return items.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"), F.avg(F.col("correct").cast("int")).alias("accuracy"))


def expected_calibration_error(bins: DataFrame) -> DataFrame:
    return bins.agg((F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("mean_confidence"))) / F.sum("n")).alias("ece"))


def verdict_agreement(a: DataFrame, b: DataFrame, key: str, verdicts: list[str]) -> DataFrame:
    """(compared, same, agreement) over verdicts of both passes, position by position; items of one pass only are skipped."""
    left = a.select(key, F.posexplode(F.array(*verdicts)).alias("at", "x"))
    right = b.select(key, F.posexplode(F.array(*verdicts)).alias("at", "y"))
    both = left.join(right, [key, "at"])
    return both.agg(F.count("*").alias("compared"), count_if(F.col("x") == F.col("y")).alias("same")).withColumn("agreement", ratio(F.col("same"), F.col("compared")))


def gold_counts(predicted: DataFrame, gold: DataFrame, by: list[str], key: list[str]) -> DataFrame:
    """tp, fp, fn of distinct keys, by group, from one full outer join."""
    p, g = predicted.select(*by, *key).distinct().withColumn("_p", F.lit(1)), gold.select(*by, *key).distinct().withColumn("_g", F.lit(1))
    both = p.join(g, [*by, *key], "full_outer")
    counts = both.groupBy(*by).agg(count_if(F.col("_p").isNotNull() & F.col("_g").isNotNull()).alias("tp"), count_if(F.col("_g").isNull()).alias("fp"), count_if(F.col("_p").isNull()).alias("fn"))
    return counts.select(*by, "tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def gold_errors(predicted: DataFrame, gold: DataFrame, key: list[str]) -> DataFrame:
    """Keys on one side only, with error: spurious or missed."""
    p, g = predicted.select(*key).distinct(), gold.select(*key).distinct()
    return p.join(g, key, "left_anti").withColumn("error", F.lit("spurious")).unionByName(g.join(p, key, "left_anti").withColumn("error", F.lit("missed")))


def sum_scores(scores: DataFrame) -> DataFrame:
    """Micro average of rows with tp, fp, fn."""
    total = scores.agg(*(F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn")))
    return total.select("tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def match_surfaces(relations: DataFrame, gold: DataFrame) -> DataFrame:
    """relations (relation_id, type, sources array, targets array) with the first gold key (source, type, target)
    that any pair of their surface forms has."""
    forms = relations.select("relation_id", "type", F.posexplode("sources").alias("i", "source"), "targets").select("relation_id", "type", "i", "source", F.posexplode("targets").alias("j", "target"))
    hit = forms.join(gold.select("source", "type", "target").distinct(), ["source", "type", "target"])
    first = hit.groupBy("relation_id").agg(F.min_by(F.struct("source", "type", "target"), F.struct("i", "j")).alias("gold"))
    return relations.join(first, "relation_id", "left")


def sample_every(rows: DataFrame, n: int, order: str, by: list[str]) -> DataFrame:
    at = F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1
    return rows.withColumn("at", at).where(F.col("at") % n == 0)


def repeat_sample(rows: DataFrame, order: str, by: list[str], share: float = 0.1) -> DataFrame:
    """Evenly spaced: k = max(1, round(n * share)) rows, floor(n / k) apart."""
    w = Window.partitionBy(*by)
    at = rows.withColumn("at", F.row_number().over(w.orderBy(order)) - 1).withColumn("n", F.count("*").over(w))
    k = F.greatest(F.lit(1), F.floor(F.col("n") * share + 0.5)).cast("int")
    step = F.floor(F.col("n") / k).cast("int")
    return at.where((F.col("at") % step == 0) & (F.floor(F.col("at") / step) < k)).drop("n")


@F.pandas_udf(ArrayType(IntegerType()))
def occurrences(text: pd.Series, quote: pd.Series) -> pd.Series:
    """All (overlapping) places of a quote, counted from 0. A search goes on behind the last place found; Spark's substrings
    would each count their way from the text's start."""

    def places(t: str | None, q: str | None) -> list[int]:
        found, at = [], t.find(q) if t and q else -1
        while at >= 0:
            found.append(at)
            at = t.find(q, at + 1)
        return found

    return pd.Series([places(t, q) for t, q in zip(text, quote, strict=True)], dtype=object)


def quoted(docs: DataFrame, quotes: DataFrame, words: int = 5) -> DataFrame:
    """(doc_id, quote_id, text, quote): the quotes (quote_id, quote) that a document (doc_id, text) holds verbatim.

    A quote's inner words, all but its first and last, are whole words of any text that holds it. Its
    key is the smallest hash of its runs of `words` inner words (of its inner words, if fewer; of its
    first character, if none). Documents meet quotes on such keys, not all quotes, and only then are
    texts searched. Blank quotes are nowhere.
    """
    inner = lambda x: F.filter(F.split(x, r"\s+"), lambda w: w != "")
    runs = lambda w, n: F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(F.slice(w, i + 1, n)))
    q = quotes.where("trim(quote) <> ''").withColumn("w", F.split("quote", r"\s+")).withColumn("w", F.slice("w", F.lit(2), F.greatest(F.size("w") - 2, F.lit(0))))
    size = F.least(F.size("w"), F.lit(words))
    q = q.withColumn("n", size).withColumn("key", F.when(F.col("n") == 0, F.xxhash64(F.substring("quote", 1, 1))).otherwise(F.array_min(runs(F.col("w"), F.greatest(F.col("n"), F.lit(1))))))
    lengths = sorted(r["n"] for r in q.select("n").distinct().collect())  # words + 1 numbers at most
    found = []
    for n in lengths:
        keys = F.transform(F.split("text", ""), lambda c: F.xxhash64(c)) if n == 0 else F.when(F.size("w") >= n, runs(F.col("w"), F.lit(n)))
        found.append(docs.where("text is not null").withColumn("w", inner(F.col("text"))).select("doc_id", F.lit(n).alias("n"), F.explode(F.array_distinct(keys)).alias("key")))
    if not found:
        return docs.join(quotes, F.lit(False)).select("doc_id", "quote_id", "text", "quote")
    marks = found[0]
    for more in found[1:]:
        marks = marks.unionByName(more)
    met = marks.join(q.select("n", "key", "quote_id"), ["n", "key"]).select("doc_id", "quote_id").distinct()
    return met.join(quotes, "quote_id").join(docs.select("doc_id", "text"), "doc_id").where("contains(text, quote)").select("doc_id", "quote_id", "text", "quote")


def verified_misses(quotes: DataFrame, mentions: DataFrame) -> DataFrame:
    """quotes (doc_id, quote_id, text, quote) of which one occurrence, at least, overlaps no mention (doc_id, start, end)."""
    at = quotes.where("trim(quote) <> '' and contains(text, quote)").select("doc_id", "quote_id", F.length("quote").alias("n"), F.explode(occurrences(F.col("text"), F.col("quote"))).alias("q_start"))
    m = mentions.select(F.col("doc_id").alias("m_doc"), F.col("start").alias("m_start"), F.col("end").alias("m_end"))
    clear = at.join(m, F.expr("doc_id = m_doc and q_start < m_end and q_start + n > m_start"), "left_anti")
    return clear.groupBy("doc_id", "quote_id").agg(F.min("q_start").alias("first_clear"), F.count("*").alias("clear"))


def cluster_purity(judged: DataFrame) -> DataFrame:
    return judged.agg(count_if(F.col("pure")).alias("pure"), F.count("*").alias("judged")).withColumn("purity", ratio(F.col("pure"), F.col("judged")))


def judge_passes(rates: DataFrame, floor: float = 0.9) -> DataFrame:
    """rates (gold, shuffled, foreign_rate, empty, errors): a judge passes with all rates at the floor and no error; an absent foreign rate is 1."""
    ok = (F.col("gold") >= floor) & (F.col("shuffled") >= floor) & (F.coalesce("foreign_rate", F.lit(1.0)) >= floor) & (F.col("empty") >= floor) & (F.col("errors") == 0)
    return rates.withColumn("passes", F.coalesce(ok, F.lit(False)))
