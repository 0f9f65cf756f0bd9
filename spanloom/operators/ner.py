"""Tagged tokens to spans, boundary candidates, and mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCEPT, REVIEW, TOKEN_P = 0.7, 0.4, 0.5
GROW, SHRINK, GAP, MOST_TOKENS, MOST_TAGGED = 2, 2, 2, 12, 40
# Characters that join words, and words that don't open or close a name.
TIGHT, LOOSE, OPENERS, CLOSERS = ("-", "–", "'", "’"), ("&",), ("(", "["), (")", "]")
ARTICLES = ("the", "a", "an")
FUNCTION_WORDS = ARTICLES + ("of", "in", "on", "at", "by", "for", "to", "from", "and", "or", "its", "his", "her", "their", "our", "this", "that", "these", "those")


def status_for(confidence: Column, accept: float = ACCEPT) -> Column:
    return F.when(confidence >= accept, "accepted").otherwise("review")


def usable(mentions: DataFrame, include_review: bool = False) -> DataFrame:
    return mentions if include_review else mentions.where("status = 'accepted'")


def is_leading_function_word(text: Column, opens_sentence: Column) -> Column:
    return text.isin(*FUNCTION_WORDS) | (F.lower(text).isin(*ARTICLES) & opens_sentence)


def is_trailing_function_word(text: Column) -> Column:
    return text.isin(*FUNCTION_WORDS)


def span_islands(tokens: DataFrame) -> DataFrame:
    """Spans of joinable entity tokens of one type.

    tokens: doc_id, chunk_id, sent_idx, tok_idx, text, start, end, kind, type (null: no entity), p.
    Tokens join if they follow one another in a sentence, or one punctuation mark stands between them
    that is an ampersand, opens onto the second, closes the first, or touches both as a hyphen or apostrophe.
    Leading and trailing function words are trimmed; a span of nothing else goes. score is the mean of
    p. A closing bracket that touches the span is taken in if it is open inside.
    """
    doc = Window.partitionBy("doc_id", "chunk_id").orderBy("tok_idx")
    at = tokens.withColumns({
        "opens": F.coalesce(F.lag("sent_idx").over(doc) != F.col("sent_idx"), F.lit(True)),
        "after": F.lead(F.struct("text", "start", "end", "sent_idx")).over(doc),
        "mark": F.lag(F.struct("text", "start", "end", "kind")).over(doc),
    }).where("type is not null")
    own = at.withColumn("before", F.lag(F.struct("tok_idx", "type", "sent_idx", "end")).over(doc))
    m, b = F.col("mark"), F.col("before")
    touches_b, touches_a = m["end"] == F.col("start"), b["end"] == m["start"]
    between = (m["kind"] == "punct") & (m["text"].isin(*LOOSE) | (m["text"].isin(*OPENERS) & touches_b) | (m["text"].isin(*CLOSERS) & touches_a) | (m["text"].isin(*TIGHT) & touches_a & touches_b))
    step = F.col("tok_idx") - b["tok_idx"]
    joins = (b["type"] == F.col("type")) & (b["sent_idx"] == F.col("sent_idx")) & ((step == 1) | ((step == 2) & between))
    numbered = own.withColumn("island", F.sum(F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).over(doc))
    isl = Window.partitionBy("doc_id", "chunk_id", "island").orderBy("tok_idx")
    numbered = numbered.withColumn("lead_word", is_leading_function_word(F.col("text"), F.col("opens"))).withColumn("trail_word", is_trailing_function_word(F.col("text")))
    numbered = numbered.withColumn("from_left", F.sum(F.when(F.col("lead_word"), 0).otherwise(1)).over(isl))
    numbered = numbered.withColumn("from_right", F.sum(F.when(F.col("trail_word"), 0).otherwise(1)).over(isl.rowsBetween(0, Window.unboundedFollowing)))
    inside = numbered.where("from_left > 0 and from_right > 0")
    spans = inside.groupBy("doc_id", "chunk_id", "island", "type").agg(
        F.min("sent_idx").alias("sent_idx"), F.min("tok_idx").alias("tok_from"), F.max("tok_idx").alias("tok_to"), F.min("start").alias("start"), F.max("end").alias("end"), F.avg("p").alias("score"),
        F.max_by("after", "tok_idx").alias("after"),
    )
    return spans.drop("island")


def close_brackets(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """spans with their text, taking in an adjacent closing bracket that balances an open one."""
    cut = lambda a, b: F.substring(F.col("doc_text"), a + 1, b - a)
    joined = spans.join(docs.select("doc_id", F.col("text").alias("doc_text")), "doc_id")
    opened = F.regexp_count(cut(F.col("start"), F.col("end")), F.lit(r"[(\[]")) > F.regexp_count(cut(F.col("start"), F.col("end")), F.lit(r"[)\]]"))
    wider = opened & F.col("after")["text"].isin(*CLOSERS) & (F.col("after")["start"] == F.col("end"))
    joined = joined.withColumn("end", F.when(F.coalesce(wider, F.lit(False)), F.col("end") + 1).otherwise(F.col("end")))
    return joined.withColumn("text", cut(F.col("start"), F.col("end"))).drop("doc_text", "after")


def boundary_candidates(spans: DataFrame, tokens: DataFrame, docs: DataFrame) -> DataFrame:
    """(span keys, ord, c_from, c_to, start, end, text) candidates: the tagged range, then grown, then shrunk by up to
    two tokens, then joined with neighbours up to two tokens away.

    Edges are pulled in to askable tokens, the left one off words that can't open a name (a capitalised
    article only where it opens the sentence), the right one off those that can't close it, a range's
    last token excepted. A candidate lies in the sentence and the chunk, has at most 12 tokens (the
    tagged range 40), takes in a closing bracket that balances an open one, holds no line end and isn't
    `none`; of equal texts of a span the first counts.

    spans: doc_id, chunk_id, span_id, sent_idx, tok_from, tok_to (both included). tokens: doc_id,
    chunk_id, tok_idx, sent_idx, text, kind, start, end. docs: doc_id, text. Tokens and spans are gathered
    by chunk, which is of bounded size, in one shuffle, and meet their document's text in another; a range
    is made, trimmed and read where its chunk's tokens are.
    """
    key = ["doc_id", "chunk_id", "span_id"]
    askable = F.col("kind").isin("word", "number")
    token = F.struct(F.col("tok_idx").cast("long").alias("i"), F.col("sent_idx").alias("sent"), F.col("start"), F.col("end"), askable.alias("askable"), F.col("text").isin(*FUNCTION_WORDS).alias("function"), F.lower("text").isin(*ARTICLES).alias("article"))
    span = F.struct("span_id", F.col("sent_idx").alias("sent_idx"), F.col("tok_from").cast("long").alias("tok_from"), F.col("tok_to").cast("long").alias("tok_to"))
    # null structs aren't collected, so that both kinds of rows share one shuffle
    both = tokens.where("chunk_id is not null").select("doc_id", "chunk_id", token.alias("t"), F.lit(None).alias("s")).unionByName(spans.select("doc_id", "chunk_id", F.lit(None).alias("t"), span.alias("s")))
    held = both.groupBy("doc_id", "chunk_id").agg(F.array_sort(F.collect_list("t")).alias("ts"), F.collect_list("s").alias("spans")).where("size(spans) > 0 and size(ts) > 0")
    lo = F.col("ts")[0]["start"]
    # the chunk's text, and one character more for a closing bracket
    own = F.substring(F.col("doc_text"), lo + 1, F.element_at("ts", -1)["end"] - lo + 1)
    rows = held.join(docs.select("doc_id", F.col("text").alias("doc_text")), "doc_id").select("doc_id", "chunk_id", "ts", "spans", own.alias("chunk_text"), lo.alias("lo"))
    opens = lambda x, i: F.coalesce(F.get("ts", i - 1)["sent"] != x["sent"], F.lit(True))
    flagged = F.transform("ts", lambda x, i: F.struct(
        x["i"].alias("i"), x["sent"].alias("sent"), x["start"].alias("start"), x["end"].alias("end"), x["askable"].alias("askable"),
        (~x["askable"] | x["function"] | (x["article"] & opens(x, i))).alias("lead"), (~x["askable"] | x["function"]).alias("trail")))
    rows = rows.withColumn("ts", flagged).select("doc_id", "chunk_id", F.explode("spans").alias("s"), "spans", "ts", "chunk_text", "lo")
    offsets = [(0, 0)] + [(-a, b) for a in range(GROW + 1) for b in range(GROW + 1) if (a, b) != (0, 0)] + [(a, -b) for a in range(SHRINK + 1) for b in range(SHRINK + 1) if (a, b) != (0, 0)]
    table = F.array(*(F.struct(F.lit(i).cast("long").alias("ord"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in enumerate(offsets)))
    shifted = F.transform(table, lambda o: F.struct(o["ord"].alias("ord"), (F.col("s.tok_from") + o["a"]).alias("c_from"), (F.col("s.tok_to") + o["b"]).alias("c_to")))
    beside = lambda o: (o["span_id"] != F.col("s.span_id")) & ((F.col("s.tok_from") - o["tok_to"]).between(1, GAP + 1) | (o["tok_from"] - F.col("s.tok_to")).between(1, GAP + 1))
    joined = F.transform(F.filter("spans", beside), lambda o: F.struct((F.lit(1000) + o["tok_from"] - F.col("s.tok_from")).alias("ord"), F.least(F.col("s.tok_from"), o["tok_from"]).alias("c_from"), F.greatest(F.col("s.tok_to"), o["tok_to"]).alias("c_to")))
    ranges = F.filter(F.concat(shifted, joined), lambda r: r["c_from"] <= r["c_to"])
    parts = F.transform(ranges, lambda r: F.struct(r["ord"].alias("ord"), r["c_from"].alias("c_from"), r["c_to"].alias("c_to"), F.filter("ts", lambda t: t["i"].between(r["c_from"], r["c_to"])).alias("t")))
    parts = rows.select("doc_id", "chunk_id", "s.span_id", "s.sent_idx", "s.tok_from", "s.tok_to", "chunk_text", "lo", F.inline(parts))
    parts = parts.where(F.size("t") == F.col("c_to") - F.col("c_from") + 1)
    parts = parts.withColumn("first", F.coalesce(F.get(F.filter("t", lambda x: ~x["lead"]), F.lit(0)), F.element_at("t", -1)))
    parts = parts.withColumn("last", F.coalesce(F.try_element_at(F.filter("t", lambda x: ~x["trail"] & (x["i"] >= F.col("first.i"))), F.lit(-1)), F.col("first")))
    size = F.col("last.i") - F.col("first.i") + 1
    tagged = (F.col("first.i") == F.col("tok_from")) & (F.col("last.i") == F.col("tok_to"))
    fits = F.col("first.askable") & F.col("last.askable") & (F.col("first.sent") == F.col("sent_idx")) & (F.col("last.sent") == F.col("sent_idx"))
    found = parts.where(fits & (size <= F.when(tagged, MOST_TAGGED).otherwise(MOST_TOKENS)))
    kinds = dict(tokens.dtypes)
    found = found.select(*key, F.col("ord").cast("int").alias("ord"), *(F.col(f"{e}.i").cast(kinds["tok_idx"]).alias(c) for e, c in (("first", "c_from"), ("last", "c_to"))), F.col("first.start").alias("start"), F.col("last.end").alias("end"), "chunk_text", "lo")
    texts = sliced(found).where("not text rlike '\\n' and text <> 'none'")
    by = [*key, "text"]
    return texts.groupBy(*by).agg(F.min(F.struct("ord", "c_from", "c_to", "start", "end")).alias("c")).select(*key, *(f"c.{x}" for x in ("ord", "c_from", "c_to", "start", "end")), "text")


def sliced(ranges: DataFrame) -> DataFrame:
    """ranges (start, end, chunk_text from lo on, ..) with text, an adjacent closing bracket that balances an open one taken in."""
    cut = lambda a, n: F.substring(F.col("chunk_text"), a - F.col("lo") + 1, n)
    rows = ranges.withColumn("plain", cut(F.col("start"), F.col("end") - F.col("start"))).withColumn("next", cut(F.col("end"), F.lit(1)))
    wider = (F.regexp_count("plain", F.lit(r"[(\[]")) > F.regexp_count("plain", F.lit(r"[)\]]"))) & F.col("next").isin(*CLOSERS)
    rows = rows.withColumn("text", F.when(wider, F.concat("plain", "next")).otherwise(F.col("plain"))).withColumn("end", F.when(wider, F.col("end") + 1).otherwise(F.col("end")))
    return rows.drop("plain", "next", "chunk_text", "lo")


def drop_overlaps(items: DataFrame, key: list[str], accept: float = ACCEPT, carried: tuple[str, ...] = ()) -> DataFrame:
    """The items kept by greedy choice: accepted first, then longer, then more confident, then first in order.

    items: key, ord, start, end, confidence, and carried: columns that go along, so that no join has to fetch them
    again. One array per key (a chunk), folded in priority order.
    """
    entry = F.struct((F.col("confidence") < accept).cast("int").alias("a"), (F.col("start") - F.col("end")).alias("l"), (-F.col("confidence")).alias("c"), "ord", "start", "end", *([F.struct(*carried).alias("with")] if carried else []))
    grouped = items.groupBy(*key).agg(F.array_sort(F.collect_list(entry)).alias("items"))
    none = F.filter("items", lambda x: F.lit(False))
    kept = F.aggregate("items", none, lambda acc, x: F.when(F.exists(acc, lambda k: (k["start"] < x["end"]) & (k["end"] > x["start"])), acc).otherwise(F.concat(acc, F.array(x))))
    at = F.array_sort(F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["ord"].alias("ord"), (-x["c"]).alias("confidence"), *([x["with"].alias("with")] if carried else []))))
    return grouped.select(*key, F.posexplode(at).alias("idx", "i")).select(*key, "idx", "i.ord", "i.start", "i.end", "i.confidence", *(F.col("i.with")[c].alias(c) for c in carried))


def spans_to_mentions(spans: DataFrame, docs: DataFrame, review: float = REVIEW, accept: float = ACCEPT) -> DataFrame:
    """Spans straight to mentions (no boundary or type questions): score is confidence and type probability."""
    strong = spans.where(F.col("score") >= review).withColumn("ord", F.col("tok_from"))
    rows = drop_overlaps(strong.withColumn("confidence", F.col("score")), ["doc_id", "chunk_id"], accept, ("sent_idx", "type", "text"))
    return rows.select(
        "doc_id", "chunk_id", F.concat_ws("", "chunk_id", F.lit("-m"), F.col("idx").cast("string")).alias("mention_id"), "sent_idx", "text", "start", "end", "type", "confidence",
        F.lit(None).cast("double").alias("boundary_p"), F.col("confidence").alias("type_p"), status_for(F.col("confidence"), accept).alias("status"),
    )
