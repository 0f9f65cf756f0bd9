"""The corpus operators against brute force, and on nulls, empties, ties, repeats and clashing columns."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from spanloom.llm import embedding_dedup, fingerprints, language_id, line_dedup, mixing, order_minhash, preferences, quality, sentence_pieces, sharding
from spanloom.operators.components import connected_components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, _plan string, slot int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empties, blanks, a repeated row, copies, a null id, a long text and clashing columns."""
    line = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, " \n "), (4, line), (5, line), (5, line), (6, f"own words here\n{line}\nthe end"), (None, line), (7, "x" * 5000), (8, " ".join(f"v{i % 977}" for i in range(30_000))), (9, "one two"), (10, "one two")]
    return spark.createDataFrame([(i, t, None if i == 2 else "en", None if i == 3 else "s", None, "x", "y", 1) for i, t in rows], DOCS)


def test_sentence_pieces(spark, docs, odd):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    extra = spark.createDataFrame([(-1, "▁a  b \t▁▁ c \n\n 😀é <s> </s> ﬁ "), (-2, " "), (-3, "   ")], "doc_id bigint, text string")
    for df in (docs.select("doc_id", "text"), odd.select("doc_id", "text"), extra, docs.select("doc_id", "text").limit(0)):
        texts = Counter((r.doc_id, r.text) for r in df.collect())
        want = Counter()
        for (i, t), n in texts.items():
            ids = sp.encode(t or "", add_eos=True)
            want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()] += n
        assert Counter(map(tuple, sentence_pieces.digests(sentence_pieces.encode_documents(df)).collect())) == want


def brute_runs(texts, most=50):
    """Lines that lie in a run of 50 words or more that came before, by trying every run."""
    seen, must = {}, defaultdict(set)
    for i in sorted(texts):
        lines = texts[i].split("\n")
        size = [max(1, len(x.split())) for x in lines]
        for s in range(len(lines)):
            n, e = 0, s
            while e < len(lines) and n < most:
                n += size[e]
                e += 1
            if n >= most:
                run = tuple(lines[s:e])
                if run in seen and (seen[run][0] != i or seen[run][1] + len(run) <= s):
                    must[i].update(range(s, e))
                seen.setdefault(run, (i, s))
    return must


def test_line_dedup(docs, odd):
    texts = {r.doc_id: r.text for r in docs.collect()}
    must = brute_runs(texts)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert set(got) == set(texts) and must
    earlier = set()
    for i in sorted(texts):
        lines, kept = texts[i].split("\n"), got[i].text.split("\n")
        assert len(must.get(i, ())) <= got[i].n_removed
        if i not in must:
            assert got[i].text == texts[i]
        at = iter(lines)
        assert got[i].n_removed == len(lines) or all(x in at for x in kept)  # what stays is in order
        for x in (Counter(lines) - Counter(kept)):
            assert x in earlier or lines.count(x) > 1  # what goes was there before
        earlier |= set(lines)
    rows = line_dedup.dedup_lines(odd).collect()
    assert len(rows) == odd.count() and set(odd.columns) <= set(rows[0].asDict())
    by = {r.doc_id: r for r in rows}
    assert by[1].text is None and by[2].text == "" and by[4].n_removed == 0 and by[5].text == "" and by[6].text == "own words here\nthe end" and by[None].n_removed == 0
    assert line_dedup.dedup_lines(odd.limit(0)).count() == 0


def exact_lines(texts, most=50):
    """Lines of runs of 50 words or more that came before, by comparing every run with every place before it."""
    runs = defaultdict(set)
    for i in sorted(texts):
        lines = texts[i].split("\n")
        size = [max(1, len(x.split())) for x in lines]
        for s in range(len(lines)):
            for e in range(s + 1, len(lines) + 1):
                if sum(size[s:e]) >= most and any(lines[s:e] == o[k : k + e - s] for j, t in texts.items() if j < i for o in [t.split("\n")] for k in range(len(o))):
                    runs[i].update(range(s, e))
    return runs


def test_line_dedup_of_lines_that_occurred_alone(spark):
    """A run whose fingerprints all occurred earlier in shorter matches; and random texts of few lines against all runs."""
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    rng = np.random.default_rng(3)
    pool = [" ".join(f"p{k}w{i}" for i in range(rng.integers(1, 35))) for k in range(7)]
    few = {i: "\n".join([*(pool[k] for k in rng.permutation(7)[: rng.integers(1, 6)]), f"end {i}"]) for i in range(60)}
    for texts in ({1: f"{a}\nx", 2: f"y\n{b}", 3: f"q\n{a}\n{b}\nr", 4: f"{a}\n{b}\nz"}, few):
        got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()}
        want = exact_lines(texts)
        assert want
        for i, t in texts.items():
            assert got[i].text == "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want.get(i, ()))


def test_line_dedup_of_long_texts(spark, monkeypatch):
    """Texts of several parts against all runs; a text that is one line over and over keeps its first words."""
    monkeypatch.setattr(line_dedup, "PART_LINES", 7)
    rng = np.random.default_rng(23)
    pool = [" ".join(f"p{k}w{i}" for i in range(rng.integers(1, 20))) for k in range(60)]
    texts = {}
    for i in range(6):
        lines = [f"own {i} {k}" for k in range(30)]
        for _ in range(2):
            at, of = rng.integers(0, 30), rng.integers(0, 40)
            lines[at:at] = pool[of : of + rng.integers(3, 20)]
        texts[i] = "\n".join(lines)
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()}
    want = exact_lines(texts)
    assert want and all(got[i] == "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want.get(i, ())) for i, t in texts.items() if len(set(t.split("\n"))) == t.count("\n") + 1)
    monkeypatch.undo()
    same = spark.createDataFrame([(1, "\n".join(["one two three four five"] * 20_000))], "doc_id bigint, text string")
    r = line_dedup.dedup_lines(same).first()
    assert (r.n_lines, r.n_removed) == (20_000, 19_995)


def test_sharding(docs, odd):
    for df in (docs, odd, odd.limit(0)):
        rows, texts = sharding.shard_documents(df).collect(), [r.text for r in df.select("text").collect()]
        assert Counter(r.text_crc32 for r in rows) == Counter(zlib.crc32((t or "").encode()) for t in texts)
        assert sorted(r.size for r in rows) == sorted(len((t or "").encode()) + 1 for t in texts)
        slots = defaultdict(list)
        for r in rows:
            slots[r.shard].append(r.slot)
        count = [len(slots[s]) for s in range(16)]
        assert max(count) - min(count) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    where = defaultdict(set)
    for r in sharding.shard_documents(docs).collect():
        where[r.text_crc32, r.size].add(r.shard)
    assert all(len(v) == 1 for v in where.values())  # no group of copies is cut here


def test_sharding_fills_with_a_giant_group(spark):
    df = spark.createDataFrame([(i, "same" if i % 3 == 0 else f"t{i}") for i in range(960)], "doc_id bigint, text string")
    rows = sharding.shard_documents(df).collect()
    assert set(Counter(r.shard for r in rows).values()) == {60}
    assert len({r.shard for r in rows if r.size == 5 and r.text_crc32 == zlib.crc32(b"same")}) <= 7  # 320 rows take 6 shards at least


def test_sharding_fills_with_a_group_of_large_buckets(spark):
    df = spark.range(30_000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'same' else concat('t', id) end as text")
    rows = sharding.shard_documents(df).collect()
    assert set(Counter(r.shard for r in rows).values()) == {1875}
    assert len({r.shard for r in rows if r.text_crc32 == zlib.crc32(b"same") and r.size == 5}) == 6  # 10,000 rows take 6 shards at least


def mixed_order(docs, mixed):
    """For each document: hashes of its block and of itself in each pass."""
    block = {r.doc_id: r._block for r in mixed}
    known = docs.join(docs.sparkSession.createDataFrame(list(block.items()), "doc_id bigint, block bigint"), "doc_id")
    key = F.xxhash64("doc_id", "text", F.lit("mix"))
    return known.select("doc_id", "source", F.array(*(F.xxhash64("source", "block", F.lit(e), F.lit("block")) for e in range(5))).alias("block"), F.array(*(F.xxhash64(key, F.lit(e)) for e in range(5))).alias("place")).collect()


def test_mixing(docs, odd):
    mixed = mixing.mix(docs, flatten=0.5, block_docs=6).collect()
    tokens = Counter()
    for r in docs.collect():
        tokens[r.source] += len(r.text.split())
    total, n = sum(tokens.values()), len(tokens)
    share = {s: t / total for s, t in tokens.items()}
    entropy = lambda w: -sum(x * math.log(x) for x in w if x)
    lo, hi = 0.0, 1.0
    target = entropy(share.values()) + 0.5 * (math.log(n) - entropy(share.values()))
    for _ in range(60):
        t = (lo + hi) / 2
        z = sum(p**t for p in share.values())
        lo, hi = (lo, t) if entropy([p**t / z for p in share.values()]) <= target else (t, hi)
    assert abs(mixed[0]._exponent - hi) < 1e-6
    z = sum(p**hi for p in share.values())
    longest = max(len(r.text.split()) for r in docs.collect())
    taken, copies = Counter(), defaultdict(list)
    for r in mixed:
        taken[r.source] += r._tokens
        copies[r.doc_id].append(r._epoch)
    for s, p in share.items():
        assert -1 <= taken[s] - p**hi / z * total <= longest + 1
    assert all(sorted(e) == list(range(len(e))) for e in copies.values())
    # the order of each pass, and what the last one takes, against the plain order of its hashes
    hashed = mixed_order(docs, mixed)
    by = defaultdict(list)
    for r in mixed:
        by[r.source, r._epoch].append(r)
    for (s, e), rows in by.items():
        want = sorted((x for x in hashed if x.source == s), key=lambda x: (x.block[e], x.place[e]))
        rows.sort(key=lambda r: r._position)
        assert [r._position for r in rows] == list(range(len(rows))) and [r.doc_id for r in rows] == [x.doc_id for x in want[: len(rows)]]
        if (s, e + 1) in by:
            assert len(rows) == len(want)
    assert any([r.doc_id for r in by[s, 0]][:9] != [r.doc_id for r in by[s, 1]][:9] for s, e in by if e == 1)
    capped = mixing.mix(docs, flatten=1.0, max_repeats=1.2).select("_exponent", "_epoch", "_weight", "source").collect()
    assert max(r._weight / share[r.source] for r in capped) <= 1.2 + 1e-6
    got = mixing.mix(odd)
    assert got.count() >= 1 and set(odd.columns) - {"_plan"} <= set(got.columns) and mixing.mix(odd.limit(0)).count() == 0


def test_preferences(spark):
    turns = [(0, 0, "user", "q"), (0, 1, "assistant", "good"), (1, 0, "user", "q"), (1, 1, "assistant", "bad"), (1, 2, "user", None), (2, 0, None, None), (None, 0, "user", "x")]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    own = preferences.conversations(df)
    a, b = (own.where(F.col("conv_id") == i).select(F.col("turns").alias(c)) for i, c in ((0, "chosen"), (1, "rejected")))
    r = preferences.format_preferences(a.crossJoin(b)).first()
    assert r.prompt_turns == 1 and r.prompt == "<|user|>\nq<|end|>\n" and r.chosen == "<|assistant|>\ngood<|end|>\n"
    assert [r.chosen[x.start : x.end] for x in r.chosen_mask] == ["good<|end|>\n"] and [r.rejected[x.start : x.end] for x in r.rejected_mask] == ["bad<|end|>\n"]
    out = {x.conv_id: x for x in preferences.format_preferences(preferences.spliced_pairs(df)).collect()}
    assert set(out) == {0, 1, 2, None} and out[2].rejected is None and out[0].prompt == "<|user|>\nq<|end|>\n" and out[0].rejected.startswith("<|assistant|>\nbad")
    assert preferences.format_preferences(preferences.spliced_pairs(df.limit(0))).count() == 0


def test_preference_prefixes(spark):
    """Against a plain search, with ties of turns, repeated rows, one very long text, and columns that clash."""
    rng = np.random.default_rng(41)
    rows = [(c, int(rng.integers(0, 6)), ("user", "assistant", "system")[rng.integers(3)], f"t{rng.integers(3)}" * (20_000 if c == 7 else 1), "own", "own") for c in range(60) for _ in range(rng.integers(1, 7))]
    rows += rows[:20]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, prompt string, chosen string")
    of = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        of[c].append((turn, role, text))
    of = {c: [x[1:] for x in sorted(t)] for c, t in of.items()}
    got = {r.conv_id: r for r in preferences.format_preferences(preferences.spliced_pairs(df)).collect()}
    seen = set()
    for c, t in of.items():
        kept = c // 2 % (len(t) + 1)
        other = t[:kept] + of[c ^ 1][kept:]
        n = 0
        while n < min(len(t), len(other)) and t[n] == other[n]:
            n += 1
        whole = lambda x: "".join(f"<|{r}|>\n{s}<|end|>\n" for r, s in x)
        r = got[c]
        assert (r.prompt_turns, r.prompt, r.chosen, r.rejected) == (n, whole(t[:n]), whole(t[n:]), whole(other[n:]))
        for side, turns, ranges in ((r.chosen, t[n:], r.chosen_mask), (r.rejected, other[n:], r.rejected_mask)):
            assert [side[x.start : x.end] for x in ranges] == [f"{s}<|end|>\n" for a, s in turns if a == "assistant"]
        seen.add((n > kept, n == len(t), n == len(other)))
    assert len(seen) > 3


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 16))
    rows = [(i, [float(x) for x in base[i % 60] + rng.standard_normal(16) * (0.02 if i >= 60 else 0)]) for i in range(200)]
    rows += [(200, rows[0][1]), (201, rows[0][1]), (202, None), (203, [0.0] * 16), (204, [float("nan")] * 16), (205, [None] + [1.0] * 15), (206, [])]
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), block=8).collect()}
    good = [r for r in rows if r[0] < 202]
    x = np.array([r[1] for r in good])
    x /= np.linalg.norm(x, axis=1)[:, None]
    linked = x @ x.T >= 0.9
    label = np.arange(len(x))
    for _ in range(20):
        label = np.array([label[linked[i]].min() for i in range(len(x))])
    for k, (i, _) in enumerate(good):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (linked[k].sum() - 1, label[k], label[k] == i)
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(202, 207))


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_fingerprints(docs, odd):
    for df in (docs, odd.where("doc_id is not null").dropDuplicates(["doc_id"])):
        texts = {r.doc_id: r.text or "" for r in df.collect()}
        ids = sorted(texts, reverse=True)
        got = {r.doc_id: r for r in fingerprints.digests(fingerprints.edited_pairs(df)).collect()}
        jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        for k, i in enumerate(ids):
            t, after = texts[i], texts[ids[(k + 1) % len(ids)]]
            e = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
            assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
            assert abs(got[i].near_edited - jaccard(shingles(t), shingles(e))) < 0.2 and abs(got[i].near_next - jaccard(shingles(t), shingles(after))) < 0.2
    assert fingerprints.edited_pairs(odd).count() == odd.count() and fingerprints.edited_pairs(odd.limit(0)).count() == 0


def test_sketch_merge(spark):
    parts = spark.createDataFrame([(list(range(0, 600)), list(range(300, 900)))], "a array<bigint>, b array<bigint>").select(*(F.slice(F.sort_array(F.transform(c, lambda x: F.xxhash64(x))), 1, 128).alias(c) for c in "ab"))
    r = parts.select(fingerprints.resemblance(F.col("a"), F.col("b")).alias("r"), fingerprints.containment(F.col("a"), F.col("b")).alias("c"), fingerprints.distinct_shingles(fingerprints.merge(F.col("a"), F.col("b"))).alias("n")).first()
    assert abs(r.r - 1 / 3) < 0.15 and abs(r.c - 0.5) < 0.2 and abs(r.n / 900 - 1) < 0.3


def test_language_id(spark, docs, odd):
    model = language_id.train(docs)
    got = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    held = [r for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in held]) > 0.95
    odds = {r.doc_id: r for r in language_id.identify(odd, model).collect()}
    assert odds[1].lang_pred == odds[2].lang_pred == "und" and odds[8].lang_pred != "und"
    assert {r.lang_pred for r in language_id.identify(odd, language_id.train(odd.limit(0))).collect()} == {"und"}
    # the forward algorithm against a plain sum over all segmentations
    pieces = language_id.vocabulary(model.path)

    def every(w):
        if not w:
            return np.ones(len(model.langs))
        return sum(every(w[n:]) * (model.prob[pieces[w[:n]]] if w[:n] in pieces else model.prob[-2] if n == 1 else 0) for n in range(1, len(w) + 1))

    for w in ("the", "éaux", "ß☃x"):
        assert np.allclose(model.log_prob([w, "a"])[0], np.log(every("▁" + w)))
        assert np.allclose(model.long_word("▁" + w), np.log(every("▁" + w)))
    # a word is scored whole at any length, and its repetition has about twice the logarithm
    word = "thetheüßañ" * 3
    assert np.allclose(model.log_prob([word])[0], model.long_word("▁" + word))
    once, twice = (model.log_prob([word * n])[0] for n in (500, 1000))
    assert np.isfinite(twice).all() and np.allclose(twice / once, 2, atol=0.01)
    long = spark.createDataFrame([(1, "estaciones" * 3000), (2, "x" * 40), (2, "x" * 40)], "doc_id bigint, text string")
    assert [r.score > 0 for r in language_id.identify(long, model).collect()] == [True] * 3


def test_quality(spark, docs, odd):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    machine = quality.train(docs, labels)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = {r.doc_id: r for r in quality.score_documents(docs, machine).collect()}
    assert np.mean([got[i].predicted == q for i, q in truth.items() if i in got]) > 0.9
    odds = quality.score_documents(odd, machine).collect()
    assert len(odds) == odd.count() and all(0 <= r.score <= 1 for r in odds)
    # the linear-time form against all pairs
    ids, x = np.array([1, 5, 9]), np.array([0.3, -1.0, 0.5])
    pairs = sum(machine.v[ids[a]] @ machine.v[ids[b]] * x[a] * x[b] for a in range(3) for b in range(a))
    assert np.isclose(machine.logit(ids, x), machine.w0 + machine.w[ids] @ x + pairs)
    assert quality.train(docs, labels.limit(0)).w0 == 0
    # metadata: texts that differ in nothing else; null, contradicting and repeated labels
    rows = [(i, "some words here", None if i == 0 else ("good", "bad")[i % 2], i) for i in range(200)]
    alike = spark.createDataFrame(rows, "doc_id bigint, text string, kind string, score bigint")
    marks = spark.createDataFrame([(i, None if i == 4 else 1 - i % 2) for i in range(200)] + [(None, 1), (5, 0), (5, 0), (999, 1)], "doc_id bigint, quality int")
    learned = quality.train(alike.union(alike), marks, meta_cols=("kind", "score"))
    found = {r.doc_id: r.predicted for r in quality.score_documents(alike.withColumn("predicted", F.lit("x")), learned).collect()}
    assert all(found[i] == 1 - i % 2 for i in range(1, 200))
    assert quality.score_documents(alike.limit(0), learned).count() == 0


def plain_edits(a, b):
    """Edit similarity of the words, by the table of all positions."""
    a, b = a.split(), b.split()
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row = row, [i]
        for j, y in enumerate(b):
            row.append(min(above[j] + (x != y), above[j + 1] + 1, row[-1] + 1))
    return 1 - row[-1] / max(len(a), len(b), 1)


def brute_links(texts, hashes):
    """Pairs of texts with a key in common that are linked, by plain alignments, and the pairs whose shingles align, key or not."""
    counts = {i: Counter(t.split()[k] if len(t.split()) < 5 else tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))) for i, t in texts.items()}
    keys = {i: set(order_minhash.sketch_keys(order_minhash.labelled_shingles(t, hashes)).tolist()) for i, t in texts.items()}
    links, sure = [], []
    for a in texts:
        for b in texts:
            if a >= b:
                continue
            share = (counts[a] & counts[b]).total() / (counts[a] | counts[b]).total()
            if texts[a] == texts[b] or share >= 0.8 and plain_alignment(texts[a], texts[b]) >= 0.8:
                sure.append((a, b))
            elif share >= order_minhash.SHARED and keys[a] & keys[b] and plain_edits(texts[a], texts[b]) >= 0.8 - 1e-9:
                links.append((a, b))
    return links + sure, sure


def labels_of(nodes, links):
    label = {i: i for i in nodes}
    while any(label[a] != label[b] for a, b in links):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_near_duplicates(spark, odd):
    rng = np.random.default_rng(5)
    word = lambda n: [f"w{rng.integers(500)}" for _ in range(n)]
    texts, i = {}, 0
    for size in (1, 3, 12, 40, 120, 400):
        for _ in range(4):
            base = word(size)
            for edits in (0, 0, 1, 2, 6):
                t = list(base)
                for _ in range(edits):
                    t[rng.integers(len(t))] = "zz"
                texts[i] = " ".join(t)
                i += 1
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    links, sure = brute_links(texts, order_minhash.WordHashes())
    assert len(links) > len(sure) > 0
    label = labels_of(texts, links)
    got = {r.doc_id: r for r in order_minhash.near_duplicates(df).collect()}
    assert {i: r.component_id for i, r in got.items()} == label and {i for i, r in got.items() if r.kept} == set(label.values())
    odds = order_minhash.near_duplicates(odd)
    by = {r.doc_id: r for r in odds.collect()}
    assert odds.count() == odd.count() and by[5].component_id == 4 and by[10].component_id == 9 and by[1].kept and by[None].kept
    assert order_minhash.near_duplicates(odd.limit(0)).count() == 0
    # 5 twice, 10, and 6, which has 56 of 61 shingles in common with 4
    assert order_minhash.keep_one(odd, odds).count() == odd.count() - 4


def test_near_duplicates_of_planted_copies(spark):
    """Copies with words changed, put in and left out at 3 to 6 % of the places: nearly all found, and no clean text joined."""
    rng = np.random.default_rng(29)
    texts = {}
    for i in range(150):
        base = [f"w{rng.integers(20_000)}" for _ in range(rng.integers(60, 500))]
        texts[2 * i] = " ".join(base)
        copy = []
        for w in base:
            r, rate = rng.random(), 0.03 + 0.03 * (i % 5) / 4
            copy += [] if r < rate / 3 else [w, "put"] if r < 2 * rate / 3 else ["other"] if r < rate else [w]
        texts[2 * i + 1] = " ".join(copy)
    got = {r.doc_id: r.component_id for r in order_minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()}
    assert np.mean([got[2 * i + 1] == 2 * i for i in range(150)]) >= 0.9
    assert all(got[i] in (i, i - i % 2) for i in texts)


def test_near_duplicates_of_one_id_with_several_texts(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(80)) for x in "ab")
    near = a.replace("a40", "other")
    rows = [(4, a), (5, a), (5, b), (7, near), (7, b), (8, near), (8, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    left = order_minhash.keep_one(df, order_minhash.near_duplicates(df))
    assert sorted((r.doc_id, r.text) for r in left.collect() if r.text) == [(4, a), (5, b)] and left.count() == 3
    df = spark.createDataFrame([(4, a), (4, near)], "doc_id bigint, text string")
    assert order_minhash.keep_one(df, order_minhash.near_duplicates(df)).count() == 1


def test_near_duplicates_in_large_keys(spark, monkeypatch):
    """Many texts with one passage, some near each other, some not: nothing is missed over several blocks."""
    monkeypatch.setattr(order_minhash, "BLOCK_SHINGLES", 4000)
    monkeypatch.setattr(order_minhash, "OWN_BLOCKS_FROM", 8)
    rng = np.random.default_rng(11)
    base = [f"b{i}" for i in range(150)]
    texts = {}
    for i in range(90):
        t = base[: rng.integers(80, 151)]
        at = rng.integers(0, 90)
        own = rng.integers(10, 60)
        texts[i] = " ".join([*t[:at], *(f"x{rng.integers(10**6)}" for _ in range(own)), *t[at:]])
    links, _ = brute_links(texts, order_minhash.WordHashes())
    label = labels_of(texts, links)
    got = {r.doc_id: r.component_id for r in order_minhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()}
    assert got == label and 1 < len(set(label.values())) < len(texts)


def plain_alignment(a, b):
    """Longest common subsequence of the five-word shingles, by the table of all positions."""
    a, b = ([tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] for w in (a.split(), b.split()))
    row = [0] * (len(b) + 1)
    for x in a:
        above, row = row, [0]
        for j, y in enumerate(b):
            row.append(above[j] + 1 if x == y else max(above[j + 1], row[-1]))
    return row[-1] / (len(a) + len(b) - row[-1])


def test_alignment_of_repeated_passages(spark, monkeypatch):
    """A copy of a passage may match any other copy: against a plain alignment, listed matches and bit vectors alike."""
    rng = np.random.default_rng(17)
    line = " ".join(f"l{i}" for i in range(12))
    parts = [x for k in range(10) for x in (line, " ".join(f"o{k}x{i}" for i in range(25)))]
    pairs = [(" ".join(parts), " ".join(parts[1:])), ("a b " * 200, "a b " * 180), ("a " * 300, "a " * 260 + "b " * 9)]
    for _ in range(40):
        lines = [" ".join(f"w{rng.integers(30)}" for _ in range(rng.integers(3, 14))) for _ in range(4)]
        t = [lines[rng.integers(4)] if rng.random() < 0.6 else f"own{rng.integers(99)}" for _ in range(rng.integers(5, 30))]
        u = [x for x in t if rng.random() > 0.08] or t
        pairs.append((" ".join(t), " ".join(u)))
    linked = 0
    for few in (8, 0):
        monkeypatch.setattr(order_minhash, "FEW_MATCHES", few)
        for a, b in pairs:
            want, hashes = plain_alignment(a, b), order_minhash.WordHashes()
            got = order_minhash.aligned_similarity(order_minhash.plain_shingles(a, hashes), order_minhash.plain_shingles(b, hashes))
            assert np.isclose(got, want) if want >= 0.8 else got < 0.8
            linked += want >= 0.8
    assert linked > 20
    for _ in range(200):
        a = [f"w{rng.integers(6)}" for _ in range(rng.integers(0, 40))]
        b = [x for x in a if rng.random() > 0.15] + [f"w{rng.integers(6)}" for _ in range(rng.integers(0, 4))]
        want, hashes = plain_edits(" ".join(a), " ".join(b)), order_minhash.WordHashes()
        got = order_minhash.edit_similarity(*(order_minhash.word_array(" ".join(x), hashes) for x in (a, b)))
        assert np.isclose(got, want) if want >= 0.8 and (a or b) else got < 0.8 or not (a or b)
    df = spark.createDataFrame([(0, pairs[0][0]), (1, pairs[0][1]), (2, "quite other words than those")], "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in order_minhash.near_duplicates(df).collect()} == {0: 0, 1: 0, 2: 2}


def test_components(spark):
    c = connected_components(spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 51), (51, 50), (60, 60)], "a int, b int"))
    assert {r.node: r.component for r in c.collect()} == {**{i: 0 for i in range(31)}, 50: 50, 51: 50}


def test_pipeline(spark, docs):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    stage = docs
    counts = []
    for name, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, SF).cache()
        counts.append(stage.count())
        assert stage.columns == docs.columns
        if name == "quality_classifier":
            left = {r.doc_id for r in stage.collect()}
            assert all(i in left for i, q in labels.items() if q == 1)
    assert 0 < counts[2] <= counts[1] == counts[0] <= docs.count()
    out = corpus_pipeline.STAGES[-1][1](spark, stage, SF)
    assert out.count() == counts[3]


def test_embeddings_odd_rows(spark):
    """Null and repeated ids, another length, a clashing column, an empty table."""
    v, w = [1.0, 0.0, 0.5], [1.0, 0.0]
    rows = [(1, v, 7), (1, v, 8), (2, w, 7), (3, [2 * x for x in v], 7), (None, v, 7), (4, [-x for x in v], 7), (5, [1.0, None, 1.0], 7)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, n_links bigint")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in embedding_dedup.near_duplicates(df).collect())
    assert got == [(0, 0, 0, True), (1, 2, 1, True), (1, 2, 1, True), (2, 0, 2, True), (3, 2, 1, False), (4, 0, 4, True), (5, 0, 5, True)]
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_fingerprints_of_repeated_and_null_ids(spark):
    rows = [(1, "a b c"), (1, "a b c"), (2, None), (None, "x"), (None, "y z"), (3, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("sketch", F.lit("own"))
    got = fingerprints.digests(fingerprints.edited_pairs(df)).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in got) == sorted((i or 0, len(t or "")) for i, t in rows)
    assert len({r.fingerprint for r in got if r.doc_id == 1}) == 1 and {r.fingerprint for r in got if r.doc_id in (2, 3)} == {""}
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_components_of_null_ends(spark):
    df = spark.createDataFrame([(1, None), (None, 2), (3, 4), (4, 3)], "a int, b int")
    assert {r.node: r.component for r in connected_components(df).collect()} == {3: 3, 4: 3}
    assert connected_components(df.limit(0)).count() == 0


def test_pipeline_on_odd_rows(spark, odd):
    """Nulls, empties, repeated rows, clashing columns and an empty table go through every stage; a user's columns come back as they were."""
    for start in (odd, odd.limit(0)):
        stage = start
        for name, f in corpus_pipeline.STAGES[1:-1]:
            before = {(r.doc_id, r.score, r._plan, r.slot) for r in stage.collect()}
            stage = f(spark, stage, SF).cache()
            assert stage.columns == odd.columns and {(r.doc_id, r.score, r._plan, r.slot) for r in stage.collect()} <= before
        assert corpus_pipeline.STAGES[-1][1](spark, stage, SF).count() == stage.count()
        assert corpus_pipeline.STAGES[0][1](spark, start, SF).columns == odd.columns
