"""Questions about words, phrases and pairs, as rows, and what their answers make of them.

A question is a row (doc_id, chunk_id, q_id, .., options): the state is the chunk's, so that an answerer
takes all questions of a chunk in one request. Answers come back as (.., choice, p_none, p_choice).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators import ner
from spanloom.operators.entities import most_common_surface, route
from spanloom.schemas import ExtractionSchema

NEAR_TOKENS = 8
# Labels that stand for no entity, and what the levels of an alignment mean.
NONE, NOT_AN_ENTITY = "none", "not_an_entity"
NONE_TEXT, PHRASE_TEXT = "The word is not part of any named entity.", "The phrase is not a named entity of any of these kinds."


def type_options(schema: ExtractionSchema, none: str = NONE, text: str = NONE_TEXT, lean: bool = False) -> Column:
    """A map from label to its description; lean: bare labels, as the state has the descriptions."""
    pairs = [(k, None if lean else d) for k, d in schema.kinds.items()] + [(none, text)]
    return F.create_map(*(x for k, d in pairs for x in (F.lit(k), F.lit(d).cast("string"))))


def chunk_states(chunks: DataFrame, docs: DataFrame, schema: ExtractionSchema | None = None, lean: bool = False) -> DataFrame:
    """(doc_id, chunk_id, state): JSON of the chunk's text, the sentence before it if there is one, and, lean, the kinds.

    chunks: doc_id, id, start, end, context_before.
    """
    grouped = chunks.groupBy("doc_id").agg(F.collect_list(F.struct("id", "start", "end", "context_before")).alias("chunks"))
    rows = grouped.join(docs.select("doc_id", F.col("text").alias("doc_text")), "doc_id").select("doc_id", "doc_text", F.explode("chunks").alias("c"))
    kinds = [type_options(schema, lean=False).alias("kinds")] if schema and lean else []
    kinds = [F.map_filter(k, lambda x, _: x != NONE).alias("kinds") for k in kinds]
    before = F.when(F.col("c.context_before") != "", F.col("c.context_before")).alias("context_before")
    text = F.substring(F.col("doc_text"), F.col("c.start") + 1, F.col("c.end") - F.col("c.start")).alias("text")
    return rows.select("doc_id", F.col("c.id").alias("chunk_id"), F.to_json(F.struct(*kinds, before, text)).alias("state"))


def chunk_words(tokens: DataFrame, docs: DataFrame, *others: str) -> DataFrame:
    """(doc_id, chunk_id, text, tokens): a chunk's text from its first to its last token, and its tokens (tok_idx, start, end
    and the others) in order, their places counted in that text. Tokens are shuffled by chunk, then by document to meet its text."""
    held = tokens.where("chunk_id is not null").groupBy("doc_id", "chunk_id").agg(F.array_sort(F.collect_list(F.struct("tok_idx", "start", "end", *others))).alias("tokens"))
    lo, hi = F.col("tokens")[0]["start"], F.element_at("tokens", -1)["end"]
    rows = held.join(docs.select("doc_id", F.col("text").alias("_text")), "doc_id")
    placed = F.transform("tokens", lambda t: F.struct(t["tok_idx"].alias("tok_idx"), (t["start"] - lo).alias("start"), (t["end"] - lo).alias("end"), *(t[c].alias(c) for c in others)))
    return rows.select("doc_id", "chunk_id", F.substring(F.col("_text"), lo + 1, hi - lo).alias("text"), placed.alias("tokens"))


def marked(text: Column, left: Column, start: Column, end: Column, right: Column) -> Column:
    """The text from left to right with [[ ]] about start to end, white space collapsed."""
    part = lambda a, b: F.substring(text, a + 1, b - a)
    return F.regexp_replace(F.concat(part(left, start), F.lit("[["), part(start, end), F.lit("]]"), part(end, right)), r"\s+", " ")


def marked_in_context(ranges: DataFrame, tokens: DataFrame, docs: DataFrame) -> DataFrame:
    """ranges (doc_id, chunk_id, c_from, c_to, ..) with marked: the words in [[ ]] among up to eight tokens on both sides
    in the chunk, white space collapsed. Ranges meet their chunk's tokens in one join."""
    held = chunk_words(tokens, docs).select("doc_id", "chunk_id", F.col("text").alias("_text"), F.col("tokens").alias("_tokens"))
    near = F.filter("_tokens", lambda t: t["tok_idx"].between(F.col("c_from") - NEAR_TOKENS, F.col("c_to") + NEAR_TOKENS))
    rows = ranges.join(held, ["doc_id", "chunk_id"]).withColumn("_near", near)
    place = lambda i, field: F.get(F.filter("_near", lambda t: t["tok_idx"] == F.col(i)), F.lit(0))[field]
    rows = rows.withColumns({"_start": place("c_from", "start"), "_end": place("c_to", "end")}).where("_start is not null and _end is not null")
    text = marked(F.col("_text"), F.col("_near")[0]["start"], F.col("_start"), F.col("_end"), F.element_at("_near", -1)["end"])
    return rows.select(*ranges.columns, text.alias("marked"))


def tag_questions(tokens: DataFrame, docs: DataFrame, schema: ExtractionSchema, lean: bool = False) -> DataFrame:
    """One question for each word or number in a chunk: (doc_id, chunk_id, q_id t<i>, tok_idx, word, marked, options)."""
    return chunk_tag_questions(chunk_words(tokens, docs, "text", "kind"), schema, lean)


def chunk_tag_questions(chunks: DataFrame, schema: ExtractionSchema, lean: bool = False) -> DataFrame:
    """tag_questions of chunks (doc_id, chunk_id, text, tokens: tok_idx, start, end, text, kind, as of chunk_words): a chunk
    has all that its questions show, so that nothing is shuffled."""
    at = lambda i, field: F.get("tokens", i)[field]
    window = F.transform("tokens", lambda t, i: F.struct(
        t["tok_idx"].alias("tok_idx"), t["text"].alias("word"), t["kind"].alias("kind"), at(F.greatest(i - NEAR_TOKENS, F.lit(0)), "start").alias("left"), t["start"].alias("start"), t["end"].alias("end"),
        at(F.least(i + NEAR_TOKENS, F.size("tokens") - 1), "end").alias("right")))
    rows = chunks.select("doc_id", "chunk_id", F.col("text").alias("_text"), F.inline(window)).where(F.col("kind").isin("word", "number"))
    text = marked(F.col("_text"), F.col("left"), F.col("start"), F.col("end"), F.col("right"))
    return rows.select("doc_id", "chunk_id", F.concat(F.lit("t"), F.col("tok_idx").cast("string")).alias("q_id"), "tok_idx", "word", text.alias("marked"), type_options(schema, lean=lean).alias("options"))


def boundary_questions(candidates: DataFrame, spans: DataFrame, tokens: DataFrame, docs: DataFrame) -> DataFrame:
    """One question b<i> for each span that has a candidate: which phrase is the mention, or none."""
    options = candidates.groupBy("doc_id", "chunk_id", "span_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda c: c["text"]).alias("options"))
    rows = spans.select("doc_id", "chunk_id", "span_id", F.col("tok_from").alias("c_from"), F.col("tok_to").alias("c_to")).join(options, ["doc_id", "chunk_id", "span_id"])
    return marked_in_context(rows, tokens, docs).select("doc_id", "chunk_id", F.concat(F.lit("b"), F.col("span_id").cast("string")).alias("q_id"), "span_id", "marked", F.concat("options", F.array(F.lit(NONE))).alias("options"))


def picked_phrases(candidates: DataFrame, answers: DataFrame, review: float = ner.REVIEW, accept: float = ner.ACCEPT) -> DataFrame:
    """Phrases that the boundary answers (doc_id, chunk_id, span_id, choice, p_none, p_choice) pick, without overlaps.

    How a phrase is sure to be an entity is 1 - p_none, whatever the boundary: below review it goes.
    """
    sure = answers.where(F.col("choice") != NONE).withColumn("confidence", 1 - F.coalesce("p_none", F.lit(0.0))).where(F.col("confidence") >= review)
    sure = sure.select("doc_id", "chunk_id", "span_id", F.col("choice").alias("text"), "confidence", F.coalesce("p_choice", F.lit(0.0)).alias("boundary_p"))
    # candidates and answers are dealt by chunk once: a join would deal both by all its keys, and the choice within a chunk again
    own = [c for c in candidates.columns if c not in ("doc_id", "chunk_id", "span_id", "text", "ord")]
    both = candidates.select("doc_id", "chunk_id", "span_id", "text", F.struct(*own).alias("candidate")).unionByName(sure.select("doc_id", "chunk_id", "span_id", "text", F.struct("confidence", "boundary_p").alias("said")), allowMissingColumns=True)
    same = Window.partitionBy("doc_id", "chunk_id", "span_id", "text")
    picked = both.repartition("doc_id", "chunk_id").withColumn("said", F.collect_list("said").over(same)).where("candidate is not null and doc_id is not null and chunk_id is not null and span_id is not null and text is not null")
    picked = picked.select("doc_id", "chunk_id", F.col("span_id").alias("ord"), "text", "candidate.*", F.inline("said"))
    rest = [c for c in picked.columns if c not in ("doc_id", "chunk_id", "ord")]
    kept = ner.drop_overlaps(picked, ["doc_id", "chunk_id"], accept, tuple(c for c in rest if c not in ("start", "end", "confidence")))
    return kept.select("doc_id", "chunk_id", F.col("idx").alias("phrase_id"), *rest)


def type_questions(phrases: DataFrame, tokens: DataFrame, docs: DataFrame, schema: ExtractionSchema, lean: bool = False) -> DataFrame:
    """One question y<i> for each phrase: of which kind it is, as it is used there."""
    marked = marked_in_context(phrases, tokens, docs)
    return marked.select("doc_id", "chunk_id", F.concat(F.lit("y"), F.col("phrase_id").cast("string")).alias("q_id"), "phrase_id", F.col("text").alias("phrase"), "marked", type_options(schema, NOT_AN_ENTITY, PHRASE_TEXT, lean).alias("options"))


def resolved_mentions(phrases: DataFrame, answers: DataFrame, tokens: DataFrame, review: float = ner.REVIEW, accept: float = ner.ACCEPT) -> DataFrame:
    """Mentions from phrases and type answers (doc_id, chunk_id, phrase_id, choice, p_choice).

    confidence is that of being an entity times that of the kind; below review, or of no kind, a phrase goes.
    """
    typed = answers.where(F.col("choice") != NOT_AN_ENTITY).select("doc_id", "chunk_id", "phrase_id", F.col("choice").alias("type"), F.coalesce("p_choice", F.lit(0.0)).alias("type_p"))
    # phrases, answers and tokens are dealt by document once: joins would deal them by their keys, and the choice within a chunk again
    phrase = F.struct("text", "start", "end", "confidence", "boundary_p")
    rows = phrases.select("doc_id", "chunk_id", "phrase_id", "c_from", phrase.alias("phrase"))
    rows = rows.unionByName(typed.select("doc_id", "chunk_id", "phrase_id", F.struct("type", "type_p").alias("kind")), allowMissingColumns=True)
    rows = rows.unionByName(tokens.select("doc_id", F.col("tok_idx").alias("c_from"), F.col("sent_idx").alias("sent")), allowMissingColumns=True).repartition("doc_id")
    rows = rows.withColumn("sents", F.collect_list("sent").over(Window.partitionBy("doc_id", "c_from"))).where("chunk_id is not null").drop("sent")
    rows = rows.withColumn("kinds", F.collect_list("kind").over(Window.partitionBy("doc_id", "chunk_id", "phrase_id"))).where("phrase is not null and doc_id is not null and phrase_id is not null and c_from is not null")
    drafts = rows.select("doc_id", "chunk_id", F.col("phrase_id").alias("ord"), "sents", "phrase.*", F.inline("kinds")).withColumn("confidence", F.col("confidence") * F.col("type_p")).where(F.col("confidence") >= review)
    kept = ner.drop_overlaps(drafts, ["doc_id", "chunk_id"], accept, ("text", "type", "boundary_p", "type_p", "sents"))
    rows = kept.withColumn("sent_idx", F.explode("sents"))
    return rows.select(
        "doc_id", "chunk_id", F.concat_ws("", "chunk_id", F.lit("-m"), F.col("idx").cast("string")).alias("mention_id"), "sent_idx", "text", "start", "end", "type",
        "confidence", "boundary_p", "type_p", ner.status_for(F.col("confidence"), accept).alias("status"),
    )


def alignment_questions(pairs: DataFrame, nodes: DataFrame, key: list[str]) -> DataFrame:
    """A row for each pair (key, type, a, b, reason) with both sides' most common surface, type and contexts."""
    by = [*key, "type"]
    side = lambda s: nodes.select(*by, F.col("normalized").alias(s), F.struct(most_common_surface(F.col("surfaces")).alias("name"), F.col("type"), F.coalesce("contexts", F.array().cast("array<string>")).alias("contexts")).alias(f"entity_{s}"))
    return pairs.join(side("a"), [*by, "a"]).join(side("b"), [*by, "b"]).select(*by, "a", "b", "reason", "entity_a", "entity_b")


def decided(answers: DataFrame) -> DataFrame:
    """Answers (.., score) with their outcome: different, review or same."""
    return answers.withColumn("outcome", route(F.col("score")))
