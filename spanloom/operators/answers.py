"""Typed questions and their answers: the lexicon answerer, conversion, batching and the answer cache."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHOSEN_P = 0.96
# Tokens aimed at in a batch, first batch, tokens a question takes before any is seen, least and most questions.
TARGET_TOKENS, FIRST_BATCH, UNSEEN_TOKENS, LEAST_BATCH, MOST_BATCH = 48_000, 40, 700, 10, 200


class Answerer(Protocol):
    """Anything that answers question rows: (.., q_id, options array<string>) to rows with choice and confidence."""

    def answer(self, questions: DataFrame) -> DataFrame: ...


class LexiconAnswerer:
    """Answers with the option a lexicon has for the question's text, else with the fallback, by one broadcast join."""

    def __init__(self, lexicon: DataFrame, fallback: str = "none"):
        self.lexicon, self.fallback = lexicon, fallback

    def answer(self, questions: DataFrame) -> DataFrame:
        known = questions.join(self.lexicon.select(F.col("key").alias("text"), F.col("value").alias("_value")), "text", "left")
        choice = F.when(F.array_contains("options", F.col("_value")), F.col("_value")).otherwise(F.lit(self.fallback))
        return known.withColumn("choice", choice).withColumn("confidence", F.lit(CHOSEN_P)).drop("_value")


def spread(options: Column, choice: Column, confidence: Column) -> Column:
    """A map of probabilities: the choice's clamped confidence, the rest in equal parts; one option is certain."""
    n = F.size(options)
    p = F.when(n == 1, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(confidence, F.lit(1.0) / n)))
    return F.map_from_arrays(options, F.transform(options, lambda o: F.when(o == choice, p).otherwise((1 - p) / F.greatest(n - 1, F.lit(1)))))


def convert_answers(answers: DataFrame) -> DataFrame:
    """answers (q_id, options, answer, confidence) with choice, p, status.

    An exact option counts, else one equal when trimmed; a missing or foreign answer becomes certain
    `none`, else `not_an_entity`, else the first option.
    """
    exact = F.array_contains("options", F.col("answer"))
    trimmed = F.array_contains("options", F.trim("answer"))
    fallback = F.when(F.array_contains("options", F.lit("none")), "none").when(F.array_contains("options", F.lit("not_an_entity")), "not_an_entity").otherwise(F.get("options", F.lit(0)))
    status = F.when(F.col("answer").isNull(), "missing").when(exact, "exact").when(trimmed, "trimmed").otherwise("invalid")
    n = F.size("options")
    p = F.when(status.isin("missing", "invalid") | (n == 1), 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.col("confidence"), F.lit(1.0) / n)))
    choice = F.when(exact, F.col("answer")).when(trimmed, F.trim("answer")).otherwise(fallback)
    return answers.withColumn("choice", choice).withColumn("p", p).withColumn("status", status)


def score_level(levels: Column, score: Column) -> Column:
    """A missing or out-of-range level is level 0."""
    return F.when((score >= 0) & (score < levels), F.floor(score)).otherwise(0).cast("int")


def tag_decision(tags: DataFrame, threshold: float = 0.5) -> DataFrame:
    """tags with probs (array of (type, p) in option order): p_entity = 1 - P(none); the likeliest other type, the first of equals, if p_entity reaches the threshold."""
    none = F.coalesce(F.aggregate(F.filter("probs", lambda x: x["type"] == "none"), F.lit(0.0), lambda a, x: a + x["p"]), F.lit(0.0))
    others = F.transform(F.filter("probs", lambda x: x["type"] != "none"), lambda x, i: F.struct(x["p"].alias("p"), (-i).alias("at"), x["type"].alias("type")))
    out = tags.withColumn("p_entity", 1 - none)
    return out.withColumn("type", F.when(F.col("p_entity") >= threshold, F.array_max(others)["type"]))


def batch_size(calls: DataFrame) -> DataFrame:
    """(stage, batch) from the largest tokens per question seen in each stage (calls: stage, input_tokens, question_count)."""
    ratio = calls.where("question_count > 0").groupBy("stage").agg(F.max(F.col("input_tokens") / F.col("question_count")).alias("ratio"))
    size = F.least(F.lit(MOST_BATCH), F.greatest(F.lit(LEAST_BATCH), F.floor(F.lit(TARGET_TOKENS) / F.col("ratio")))).cast("int")
    return ratio.select("stage", size.alias("batch"))


def batches(questions: DataFrame, sizes: DataFrame, key: list[str], order: str) -> DataFrame:
    """questions with batch_no: consecutive runs of the stage's batch size inside each key; FIRST_BATCH where none was seen."""
    at = F.row_number().over(Window.partitionBy(*key).orderBy(order)) - 1
    joined = questions.join(F.broadcast(sizes), "stage", "left")  # one row a stage
    return joined.withColumn("batch_no", F.floor(at / F.coalesce("batch", F.lit(FIRST_BATCH))).cast("int")).drop("batch")


def cache_key(model: Column, state: Column, questions: Column) -> Column:
    return F.sha2(F.to_json(F.struct(model.alias("model"), state.alias("state"), questions.alias("questions"))), 256)


def cache_probe(requests: DataFrame, cache: DataFrame, key: str = "cache_key") -> tuple[DataFrame, DataFrame]:
    """(hits, misses): requests whose key is in the cache, with its columns, and the others."""
    once = cache.dropDuplicates([key])
    return requests.join(once, key), requests.join(once.select(key), key, "left_anti")


def ask(questions: DataFrame, states: DataFrame, answerer: Answerer, cache: DataFrame, model: str, order: str = "q_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(answers, calls, new cache rows): a request holds the questions of a state; one that the cache knows is not asked.

    questions: doc_id, chunk_id, stage, q_id, text, options; states: doc_id, chunk_id, state; cache:
    cache_key, answers (array of q_id, choice, confidence). Requests that are equal are asked once. A
    call's row says how many questions it had, how large it was, and whether the cache had it. The
    pacer (operators.report.pacer) gives such rows their start times.
    """
    by = ["doc_id", "chunk_id", "stage"]
    asked = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), "q_id", "text", "options")))
    requests = questions.groupBy(*by).agg(asked.alias("questions")).join(states, ["doc_id", "chunk_id"])
    requests = requests.withColumn("cache_key", cache_key(F.lit(model), F.col("state"), F.to_json("questions")))
    hits, misses = cache_probe(requests, cache)
    open_questions = misses.dropDuplicates(["cache_key"]).select("cache_key", "state", F.explode("questions").alias("q")).select("cache_key", "state", "q.q_id", "q.text", "q.options")
    fresh = answerer.answer(open_questions).groupBy("cache_key").agg(F.array_sort(F.collect_list(F.struct("q_id", "choice", "confidence"))).alias("answers"))
    done = hits.select(*by, "cache_key", "state", "questions", "answers", F.lit(True).alias("cached")).unionByName(misses.join(fresh, "cache_key").select(*by, "cache_key", "state", "questions", "answers", F.lit(False).alias("cached")))
    answers = done.select(*by, F.explode("answers").alias("a")).select(*by, "a.*")
    calls = done.select(*by, F.lit(model).alias("model"), F.size("questions").alias("question_count"), F.length("state").alias("state_chars"), F.octet_length(F.concat("state", F.to_json("questions"))).cast("long").alias("request_bytes"), "cached")
    return answers, calls, fresh
