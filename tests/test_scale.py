"""What the queries cost at size: exchanges, rows per pair and passes, on small tables."""

import time

import pytest
from pyspark.sql import functions as F

from spanloom.operators import evaluation, ner, questions, relations
from spanloom.operators import text as T
from spanloom.plans import flagship, stages


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def folder(spark, tmp_path):
    """A folder with documents: words in one chunk, in several, with odd white space, none at all."""
    texts = ["one two", " ".join(f"w{i}" for i in range(95)), "a\t b\n\n c", "", None, "é " * 41]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_tag_questions_are_made_without_a_shuffle(spark, folder):
    """a chunk's words are at hand when its questions are made; the same as from token rows."""
    got = stages.tag_questions(spark, folder)
    assert "Exchange" not in plan_of(got)
    rows = {(r.doc_id, r.q_id): (r.chunk_id, r.word, r.marked) for r in got.collect()}
    assert len(rows) == 2 + 95 + 3 + 41
    assert rows[0, "t1"] == ("c0", "two", "one [[two]]")
    assert rows[1, "t40"] == ("c1", "w40", "[[w40]] " + " ".join(f"w{i}" for i in range(41, 49)))
    assert rows[2, "t1"] == ("c0", "b", "a [[b]] c") and rows[5, "t40"] == ("c1", "é", "[[é]]")
    chunks = stages.word_chunks(spark, folder).withColumn("text", F.upper("text"))
    docs = chunks.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.element_at("tokens", 1)["tok_idx"].alias("i"), "text"))), lambda x: x["text"]), " ").alias("text"))
    base = chunks.select("doc_id", "chunk_id", "text", F.inline("tokens").alias("tok_idx", "start", "end", "word", "kind"))
    before = chunks.where("chunk_id = 'c0'").select("doc_id", (F.length("text") + 1).alias("n")).join(chunks.where("chunk_id = 'c1'").select("doc_id", F.length("text").alias("m")), "doc_id", "left")
    at = F.when(F.col("chunk_id") == "c0", 0).when(F.col("chunk_id") == "c1", F.col("n")).otherwise(F.col("n") + F.col("m") + 1)
    tokens = base.join(before, "doc_id").select("doc_id", "chunk_id", "tok_idx", (F.col("start") + at).alias("start"), (F.col("end") + at).alias("end"), F.col("word").alias("text"), "kind")
    same = questions.tag_questions(tokens, docs, stages.SCHEMA)
    assert {(r.doc_id, r.q_id): (r.chunk_id, r.marked) for r in same.collect()} == {k: (c, m.upper()) for k, (c, _, m) in rows.items()}


def test_boundary_candidates_gather_tokens_once(spark):
    """tokens, spans and candidates go through two shuffles, of chunks and of documents, beside the texts' own; no range is a shuffled row."""
    text = "Saw (The Blue Hall) and Bell."
    words = [("Saw", 0, 3, "word"), ("(", 4, 5, "punct"), ("The", 5, 8, "word"), ("Blue", 9, 13, "word"), ("Hall", 14, 18, "word"), (")", 18, 19, "punct"), ("and", 20, 23, "word"), ("Bell", 24, 28, "word"), (".", 28, 29, "punct")]
    tokens = spark.createDataFrame([(1, "c", i, 0, *w) for i, w in enumerate(words)], "doc_id long, chunk_id string, tok_idx int, sent_idx int, text string, start int, end int, kind string")
    spans = spark.createDataFrame([(1, "c", 0, 0, 3, 4), (1, "c", 1, 0, 7, 7)], "doc_id long, chunk_id string, span_id int, sent_idx int, tok_from int, tok_to int")
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    saved = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = ner.boundary_candidates(spans, tokens, docs)
        assert plan_of(found).count("Exchange hashpartitioning") <= 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", saved)
    got = sorted((r.span_id, r.ord, r.c_from, r.c_to, r.text) for r in found.collect())
    assert (0, 0, 3, 4, "Blue Hall") in got and (0, 3, 2, 4, "The Blue Hall") in got
    assert (0, 1004, 3, 7, "Blue Hall) and Bell") in got
    assert dict(found.dtypes) == {"doc_id": "bigint", "chunk_id": "string", "span_id": "int", "ord": "int", "c_from": "int", "c_to": "int", "start": "int", "end": "int", "text": "string"}


def exchanges(df) -> int:
    return plan_of(df).count("Exchange hashpartitioning")


def test_phrases_and_mentions_are_dealt_once(spark):
    """answers, phrases and tokens go through one shuffle each step, no join deals them again; odd rows as by joins."""
    candidates = [(1, "c", s, o, s + o, s + o + 1, 10 * s + o, 10 * s + o + 15 - 5 * o, f"t{o}") for s in range(6) for o in range(3)] + [(2, "c", 0, 0, 0, 0, 0, 4, "t0"), (1, "d", 0, 0, 7, 7, 0, 4, "t0"), (3, "c", None, 0, 0, 0, 0, 1, "t0")]
    candidates = spark.createDataFrame(candidates, "doc_id long, chunk_id string, span_id int, ord int, c_from int, c_to int, start int, end int, text string")
    said = [(1, "c", 0, "t0", 0.1, 0.6), (1, "c", 1, "t1", 0.0, 0.9), (1, "c", 2, "none", 0.1, 0.9), (1, "c", 3, "t2", 0.5, None), (1, "c", 4, "t0", 0.7, 0.5), (1, "c", 5, "other", 0.1, 0.1), (1, "d", 0, "t0", None, 0.3), (2, "d", 0, "t0", 0.1, 0.3), (3, "c", None, "t0", 0.1, 0.3)]
    said = spark.createDataFrame(said, "doc_id long, chunk_id string, span_id int, choice string, p_none double, p_choice double")
    saved = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        phrases = questions.picked_phrases(candidates, said)
        assert exchanges(phrases) == 1
        assert phrases.columns == ["doc_id", "chunk_id", "phrase_id", "text", "c_from", "c_to", "start", "end", "confidence", "boundary_p"]
        got = sorted(map(tuple, phrases.collect()))
        assert got == [(1, "c", 0, "t0", 0, 1, 0, 15, 0.9, 0.6), (1, "c", 1, "t2", 5, 6, 32, 37, 0.5, 0.0), (1, "d", 0, "t0", 7, 7, 0, 4, 1.0, 0.3)]
        phrases = spark.createDataFrame([*got, (4, "c", 0, "x", 1, 1, 0, 1, 1.0, 1.0), (None, "c", 0, "x", 1, 1, 0, 1, 1.0, 1.0)], phrases.schema)
        kinds = spark.createDataFrame([(1, "c", 0, "org", 0.9), (1, "c", 1, "not_an_entity", 0.9), (1, "d", 0, "place", 0.5), (1, "d", 1, "place", 0.5), (4, "c", 0, "org", None), (None, "c", 0, "org", 1.0)], "doc_id long, chunk_id string, phrase_id int, choice string, p_choice double")
        tokens = spark.createDataFrame([(1, i, i // 4) for i in range(9)] + [(2, 0, 0), (None, 1, 0)], "doc_id long, tok_idx int, sent_idx int")
        mentions = questions.resolved_mentions(phrases, kinds, tokens)
        assert exchanges(mentions) == 1
        assert sorted(map(tuple, mentions.collect())) == [(1, "c", "c-m0", 0, "t0", 0, 15, "org", 0.9 * 0.9, 0.6, 0.9, "accepted"), (1, "d", "d-m0", 1, "t0", 0, 4, "place", 0.5, 0.3, 0.5, "review")]
        spans = spark.createDataFrame([(1, "c", 0, 3, 4, 0, 9, "org", 0.9, "a"), (1, "c", 0, 4, 4, 5, 9, "org", 0.9, "b")], "doc_id long, chunk_id string, sent_idx int, tok_from int, tok_to int, start int, end int, type string, score double, text string")
        found = ner.spans_to_mentions(spans, spans)
        assert exchanges(found) == 1 and [(r.mention_id, r.text, r.type, r.sent_idx, r.confidence) for r in found.collect()] == [("c-m0", "a", "org", 0, 0.9)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", saved)


ODD = ["", "A.", "A. B. Xu said: \"No. 5\"!\nIt's new", "x\x1cy  A. B", "Mr. é. É. D'Arcy's 3.5% U.K. test...  ok", "a " * 200, "日本。語 A.\nB", "end.  \n\n Next A. b C. D", "License MIT. " + "w, " * 100 + "BSD."]


def test_words_are_tokenized_once(spark):
    """F7, F8, F9: by words in columns, as by the pattern over each sentence; an unseen word alone costs a search."""
    words = T.Words()
    for most in (1, 3, 80):
        for text in ODD:
            sentences, tokens, chunks = T.segment_text(text, most)
            fast = T.segment_words(text, words, most)
            assert (fast is None) == ("\x1c" in text)
            if fast:
                (a, b), t, rows = fast
                assert list(zip(a.tolist(), b.tolist(), strict=True)) == [tuple(s) for s in sentences] and rows == chunks
                assert [(words.texts[i], p, q, T.KINDS[words.kinds[i]], s, f"c{c:04d}") for i, p, q, s, c in zip(*(x.tolist() for x in t), strict=True)] == tokens
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").coalesce(1)
    assert [tuple(map(tuple, r.tokens)) for r in T.segment(docs, parts=("tokens",)).orderBy("doc_id").collect()] == [tuple(T.segment_text(t)[1]) for t in ODD]
    assert T.segment(docs, parts=("chunks",)).columns == ["doc_id", "chunks"]


def test_tokens_without_a_known_word_are_not_shuffled(spark):
    """the tokenizer gives out chunks with a known word alone, as the join of all tokens finds them."""
    docs = spark.createDataFrame([*enumerate(ODD), (50, "x\x1c MIT")], "doc_id long, text string")
    lexicon = spark.createDataFrame([("License", "document"), ("MIT", "organization"), ("BSD", "organization"), ("xyz", None)], "word string, kind_of string")
    tags = flagship.lexicon_tags(docs, lexicon)
    assert "Exchange hashpartitioning" not in plan_of(tags)
    joined = flagship.lexicon_tags(docs, lexicon.union(lexicon.where("word = 'xyz'")))  # a word twice: no word list
    rows = lambda df: sorted((r.doc_id, r.start, r.text, r.chunk_id, r.type or "") for r in df.collect())
    assert rows(tags) == rows(joined) and len(rows(tags)) > 4 and {r[0] for r in rows(tags)} == {8, 50}


def test_sentence_pairs_pair_the_first_entities_alone(spark):
    """a sentence of many entities gives its first pairs without a join of all with all; as where a condition makes it join."""
    rows = [("s", e, (e * 7) % 40, "t") for e in range(60)] + [("u", 1, 2, "x"), ("u", 2, 2, "y"), ("u", 3, 1, None), ("u", 1, 9, "z"), ("v", 5, 0, "t")]
    m = spark.createDataFrame(rows, "k string, entity long, start int, type string")
    found, joined = relations.sentence_pairs(m, ["k"]), relations.sentence_pairs(m, ["k"], fits=F.lit(True))
    assert "Join" not in plan_of(found)
    assert found.columns == joined.columns and dict(found.dtypes) == dict(joined.dtypes)
    assert sorted(map(str, found.collect())) == sorted(map(str, joined.collect())) and found.count() == 15 + 3


def test_occurrences_are_linear_in_the_text(spark):
    """a place far into a text isn't counted to from its start for each place before it."""
    rows = [("é" * 400_000 + "aaa", "aa"), ("abc", "x"), ("", "a"), ("a", ""), (None, "a"), ("🙂b🙂b", "b")]
    df = spark.createDataFrame(rows, "text string, quote string").coalesce(1)
    start = time.time()
    got = [r[0] for r in df.select(evaluation.occurrences("text", "quote")).collect()]
    assert got == [[400_000, 400_001], [], [], [], [], [1, 3]] and time.time() - start < 40


def test_a_page_takes_time_by_its_lines_not_by_their_square(spark):
    """a page's longest line was looked for anew at each of its lines; long or many pages, odd rows and equal page numbers."""
    many = "\n".join(f"line {i} of the book," for i in range(20_000))
    rows = [("long", 1, many + "\nHead\nNext line.")]
    rows += [("d", p, f"  Vol. 1 \n\n{'Some Heading' if p == 2 else 'and more'}\nThe text of page {p} goes on with re-\nmarks and ends{'.' if p == 2 else ' of-'}\n- {p} -\n \n") for p in (1, 2, 3)]
    rows += [("d", 3, "another third page of the volume"), ("d", 4, None), ("d", 5, "  \n"), ("none", 1, None), ("short", 7, "7")]
    start = time.time()
    found = T.normalize_pages(spark.createDataFrame(rows, "doc_id string, page int, text string").coalesce(1))
    got = {r.doc_id: r for r in found.collect()}
    assert time.time() - start < 40
    assert got["long"].text == many.replace("\n", " ") + " Head\n\nNext line."
    # pages of one number by their bodies; a word closed up over a page end; a heading's blank line; no head and foot
    page = lambda p, end: f"The text of page {p} goes on with remarks and ends{end}"
    assert got["d"].text == f"and more\n\n{page(1, ' of-')} Some Heading\n\n{page(2, '.')}\n\nand more\n\n{page(3, ' of')}another third page of the volume"
    assert [tuple(m) for m in got["d"].page_map] == [(1, 0, 62), (2, 63, 126), (3, 128, 190), (3, 189, 221)]
    assert got["d"].skipped_pages == [5] and got["d"].page_count == 6
    assert got["none"].text == "" and got["none"].page_map == [] and got["none"].skipped_pages == [] and got["short"].skipped_pages == [7]
