"""Paged text to documents, sentences, tokens and chunks."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.text import INK, SPACE, bound, short_hash, signature, trim_all, unwrap

SCANNED_CHARS, RUNNING_SHARE, RUNNING_PAGES, HEADING_SHARE = 20, 0.5, 3, 0.6
CHUNK_ASKABLE, CONTEXT_CHARS = 80, 300

# Abbreviations that keep their period; those before a name; those before a number.
ABBREVIATIONS = ["Mr", "Mrs", "Ms", "Dr", "Prof", "St", "Jr", "Sr", "Inc", "Ltd", "Corp", "Co", "Gen", "Sen", "Rep", "Gov", "Lt", "Col", "Capt", "Sgt", "Mt", "Ft", "No", "vs", "etc"]
BEFORE_NAME = ["Mr", "Mrs", "Ms", "Dr", "Prof", "St", "Gen", "Sen", "Rep", "Gov", "Lt", "Col", "Capt", "Sgt", "Mt", "Ft", "vs"]
BEFORE_NUMBER = ["No", "Nos", "Art", "Arts", "Sec", "Para", "para", "p", "pp"]

_CHAR = r"[\p{L}\p{N}]"
TOKEN = regex.compile(
    rf"(?:\p{{L}}\.){{2,}}|(?<![A-Za-z0-9_])(?:{'|'.join(ABBREVIATIONS)})\.|\p{{Lu}}\.(?=\s+\p{{Lu}})"
    rf"|(?P<number>\p{{N}}+(?:[.,:/-]\p{{N}}+)*%?)|(?P<possessive>['’][sS](?!{_CHAR}))"
    rf"|{_CHAR}+(?:(?:['’](?![sS](?!{_CHAR}))|&){_CHAR}+)*|(?P<punct>\S)"
)
BREAK = regex.compile(r"[.!?…]+[\"'”’)\]]*\s+(?!\p{Ll})|[!?]+[\"'”’)\]]*\s+|\n+")
CONTINUES = regex.compile(rf"(?<![A-Za-z0-9_])(?:{'|'.join(BEFORE_NAME)}|\p{{Lu}})\.\s*$")
NUMBERED = regex.compile(rf"(?<![A-Za-z0-9_])(?:{'|'.join(BEFORE_NUMBER)})\.\s*$")


def scanned_pages(pages: DataFrame) -> DataFrame:
    """pages with skipped: whether so little text is left that the page must be an image."""
    return pages.withColumn("skipped", F.length(trim_all(F.col("text"))) < SCANNED_CHARS)


def edge_signatures(text):
    """The distinct signatures of a page's first and last line that isn't blank; null if all are."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(INK))
    return bound(lines, lambda x: F.when(F.size(x) > 0, F.array_distinct(F.array(signature(F.get(x, F.lit(0))), signature(F.try_element_at(x, F.lit(-1)))))))


def edge_lines(pages: DataFrame) -> DataFrame:
    """(doc_id, page, sig): the distinct signatures of a page's first and last line that isn't blank."""
    return pages.select("doc_id", "page", F.explode(edge_signatures(F.col("text"))).alias("sig"))


def least_pages(pages):
    return F.greatest(F.lit(RUNNING_PAGES), F.ceil(pages * RUNNING_SHARE))


def running_lines(pages: DataFrame) -> DataFrame:
    """(doc_id, sig, on_pages): headers and footers, on half of the pages and on three at least."""
    count = pages.groupBy("doc_id").agg(F.countDistinct("page").alias("pages"))
    found = edge_lines(pages).groupBy("doc_id", "sig").agg(F.countDistinct("page").alias("on_pages"))
    return found.join(count, "doc_id").where((F.col("pages") >= RUNNING_PAGES) & (F.col("on_pages") >= least_pages(F.col("pages")))).select("doc_id", "sig", "on_pages")


def headings(lines: DataFrame) -> DataFrame:
    """lines (doc_id, page, line_no, line) that stand alone: short against the page's longest line, not
    closed by punctuation, before a line that opens with a capital or a digit."""
    page = Window.partitionBy("doc_id", "page")
    at = lines.withColumn("t", trim_all(F.col("line"))).withColumn("longest", F.max(F.length("t")).over(page)).withColumn("after", F.lead("t").over(page.orderBy("line_no")))
    here = (F.length("t") > 0) & (F.length("t") < HEADING_SHARE * F.col("longest")) & ~F.col("t").rlike(r"[.!?,;:-]$") & F.col("after").rlike(r"^[\p{Lu}\p{N}]")
    return at.where(here).select("doc_id", "page", "line_no", F.col("t").alias("heading"))


def page_body(text, running):
    """A page without running lines (signatures), with a blank line after its headings, unwrapped.

    Each step is bound to a name that the next one's lambdas read: a column would be put into a lambda as its
    expression, and a page's longest line be looked for anew at each of its lines.
    """
    lines = F.transform(F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n"), lambda x: F.regexp_replace(x, rf"{SPACE}+$", ""))
    lines = F.transform(lines, lambda x: F.struct(x.alias("x"), F.length(trim_all(x)).alias("n")))
    drop = lambda x: F.coalesce(F.array_contains(running, signature(x)), F.lit(False))

    def without_running(ls):
        filled = F.filter(F.transform(ls, lambda l, i: F.when(l["n"] > 0, i)), lambda i: i.isNotNull())
        ends = F.struct(F.array_min(filled).alias("first"), F.array_max(filled).alias("last"))
        return bound(ends, lambda e: F.filter(ls, lambda l, i: ~(((i == e["first"]) | (i == e["last"])) & drop(l["x"])) | e["first"].isNull()))

    def with_headings(ls):
        short = F.array_max(F.transform(ls, lambda l: l["n"])) * HEADING_SHARE
        heading = lambda l, i, most: (l["n"] > 0) & (l["n"] < most) & ~l["x"].rlike(r"[.!?,;:-]$") & F.coalesce(F.get(ls, i + 1)["x"].rlike(r"^[\p{Lu}\p{N}]"), F.lit(False))
        return bound(short, lambda most: F.array_join(F.transform(ls, lambda l, i: F.when(heading(l, i, most), F.concat(l["x"], F.lit("\n"))).otherwise(l["x"])), "\n"))

    return unwrap(bound(bound(lines, without_running), with_headings))


def normalize_pages(pages: DataFrame) -> DataFrame:
    """pages (doc_id, page, text) to documents (doc_id, text, page_map, skipped_pages, sha256).

    Running lines go, headings get a blank line, pages are unwrapped and joined: a word hyphenated
    over a page end is closed up, a page that ends a sentence is followed by a blank line, any other
    by a space. page_map has (page, start, end) of each page in code points. Pages of a document are
    the only rows that meet in one place.
    """
    pages = scanned_pages(pages)
    # one scan of the texts for the pages' ends, gathered by document, and one for the texts themselves
    ends = pages.select("doc_id", F.struct("page", "skipped", F.when(~F.col("skipped"), edge_signatures(F.col("text"))).alias("sigs")).alias("e"))
    ends = ends.groupBy("doc_id").agg(F.collect_list("e").alias("ends"))
    about = ends.select("doc_id", F.array_sort(F.transform(F.filter("ends", lambda e: e["skipped"]), lambda e: e["page"])).alias("skipped_pages"), F.size("ends").cast("long").alias("page_count"))
    shown = F.size(F.array_distinct(F.transform(F.filter("ends", lambda e: ~e["skipped"]), lambda e: e["page"])))
    sigs = ends.withColumn("pages", shown).where(F.col("pages") >= RUNNING_PAGES).select("doc_id", "pages", F.inline("ends")).select("doc_id", "pages", "page", F.explode("sigs").alias("sig"))
    often = sigs.groupBy("doc_id", "pages", "sig").agg(F.countDistinct("page").alias("on_pages")).where(F.col("on_pages") >= least_pages(F.col("pages")))
    running = often.groupBy("doc_id").agg(F.collect_set("sig").alias("running"))
    # pages are dealt in as many parts as the session has for a shuffle: by bytes they would be put into few tasks, and bodies take time
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    clean = pages.where("not skipped").select("doc_id", "page", "text").repartition(parts, "doc_id").join(running, "doc_id", "left")
    # through explode, so that the filter isn't pushed below the steps that make a body, each of which it would repeat
    rows = clean.select("doc_id", F.explode(F.array(F.struct(F.col("page").cast("int").alias("page"), page_body(F.col("text"), F.col("running")).alias("body")))).alias("r")).select("doc_id", "r.*")
    rows = rows.where(F.length("body") > 0)
    # what stands between two pages depends on their ends alone, so the pages of a document are put together in one pass
    order = Window.partitionBy("doc_id").orderBy("page", "body")
    # the ends of a body decide: a pattern's $ may stand before a last line end
    tail, head = F.substring("body", -4, 4), F.substring("body", 1, 1)
    rows = rows.withColumn("prev", F.lag(tail).over(order)).withColumn("next", F.lead(head).over(order))
    broken = lambda a, b: F.coalesce(a.rlike(r"\p{L}-$") & b.rlike(r"^\p{Ll}"), F.lit(False))
    gap = F.when(F.col("prev").isNull() | broken(F.col("prev"), head), F.lit("")).when(F.col("prev").rlike(r"[.!?:;\"'”’)\]]$"), F.lit("\n\n")).otherwise(F.lit(" "))
    rows = rows.withColumn("gap", gap).withColumn("cut", F.when(broken(tail, F.col("next")), 1).otherwise(0))
    before = F.coalesce(F.sum(F.length("gap") + F.length("body") - F.col("cut")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    rows = rows.withColumn("at", F.row_number().over(order)).withColumn("start", before + F.length("gap"))
    piece = F.concat("gap", F.substring("body", F.lit(1), F.length("body") - F.col("cut")))
    part = F.struct("at", F.struct("page", "start", (F.col("start") + F.length("body")).cast("int").alias("end")).alias("span"), piece.alias("piece"))
    texts = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(part)).alias("p"))
    found = about.join(texts, "doc_id", "left").withColumn("text", F.coalesce(F.array_join(F.transform("p", lambda x: x["piece"]), ""), F.lit("")))
    page_map = F.coalesce(F.transform("p", lambda x: x["span"]), F.array().cast("array<struct<page:int,start:int,end:int>>"))
    return found.select("doc_id", "text", page_map.alias("page_map"), "skipped_pages", "page_count", F.sha2("text", 256).alias("sha256"), short_hash(F.col("text")).alias("content_id"))


def page_at(page_map, offset):
    """The first page that ends after the offset, else the last, else 1."""
    return F.coalesce(F.get(F.filter(page_map, lambda p: p["end"] > offset), F.lit(0))["page"], F.try_element_at(page_map, F.lit(-1))["page"], F.lit(1))


def split_sentences(text: str) -> list[tuple[int, int]]:
    """Ranges of the sentences: rule-based breaks, mended after abbreviations and initials."""
    cuts = [m.end() for m in BREAK.finditer(text)]
    pieces, start = [], 0
    for end in [*cuts, len(text)]:
        if end <= start:
            continue
        piece = text[start:end]
        more = text[end : end + 1]
        joined = not piece.endswith("\n") and more and (CONTINUES.search(piece) or (NUMBERED.search(piece) and more.isdigit()))
        if not joined:
            pieces.append((start, end))
            start = end
    if start < len(text):
        pieces.append((start, len(text)))
    out = []
    for a, b in pieces:
        s = text[a:b]
        if s.strip():
            out.append((a + len(s) - len(s.lstrip()), b - (len(s) - len(s.rstrip()))))
    return out


def tokenize(text: str, start: int, end: int) -> list[tuple[str, int, int, str]]:
    return [(m.group(), m.start(), m.end(), m.lastgroup or "word") for m in TOKEN.finditer(text, start, end)]


ASKABLE = ("word", "number")


def segment_text(text: str, max_askable: int = CHUNK_ASKABLE) -> tuple[list, list, list]:
    """Sentences (start, end), tokens (text, start, end, kind, sentence) and chunks.

    Sentences with more than max_askable askable tokens are cut after every max_askable-th. Chunks are
    packed greedily: one closes when the next sentence would take it over the limit. Tokens end with their chunk's
    id. Ranges of sentences and tokens are half open; chunk numbers count chunks without a token, which are dropped.
    """
    sentences, tokens = [], []
    for a, b in split_sentences(text):
        found = tokenize(text, a, b)
        asked, first, part = 0, a, []
        for token in found:
            if token[3] in ASKABLE:
                if asked == max_askable:
                    sentences.append((first, part[-1][2]))
                    tokens += [(*t, len(sentences) - 1) for t in part]
                    asked, first, part = 0, token[1], []
                asked += 1
            part.append(token)
        sentences.append((first, b))
        tokens += [(*t, len(sentences) - 1) for t in part]
    per: dict[int, list[int]] = {}
    for i, t in enumerate(tokens):
        per.setdefault(t[4], []).append(i)
    chunks, at, asked = [], 0, 0
    groups = []
    for s in range(len(sentences)):
        n = sum(tokens[i][3] in ASKABLE for i in per.get(s, []))
        if asked and asked + n > max_askable:
            groups.append((at, s))
            at, asked = s, 0
        asked += n
    if at < len(sentences):
        groups.append((at, len(sentences)))
    for k, (s, e) in enumerate(groups):
        inside = [i for x in range(s, e) for i in per.get(x, [])]
        if inside:
            before = text[slice(*sentences[s - 1])][-CONTEXT_CHARS:] if s else ""
            for i in inside:
                tokens[i] = (*tokens[i], f"c{k:04d}")
            chunks.append((f"c{k:04d}", k, sentences[s][0], sentences[e - 1][1], before, s, e, inside[0], inside[-1] + 1))
    return sentences, tokens, chunks


SEGMENTED = {
    "sentences": "array<struct<start:int,end:int>>",
    "tokens": "array<struct<text:string,start:int,end:int,kind:string,sentence:int,chunk_id:string>>",
    "chunks": "array<struct<id:string,index:int,start:int,end:int,context_before:string,sentence_start:int,sentence_end:int,token_start:int,token_end:int>>",
}

_INT, _TEXT = pa.int32(), pa.string()
TYPES = {
    "sentences": [("start", _INT), ("end", _INT)],
    "tokens": [("text", _TEXT), ("start", _INT), ("end", _INT), ("kind", _TEXT), ("sentence", _INT), ("chunk_id", _TEXT)],
    "chunks": [("id", _TEXT), ("index", _INT), ("start", _INT), ("end", _INT), ("context_before", _TEXT), ("sentence_start", _INT), ("sentence_end", _INT), ("token_start", _INT), ("token_end", _INT)],
}
KINDS = ("word", "number", "possessive", "punct")

_UPPER, _BLANK = regex.compile(r"\p{Lu}"), regex.compile(r"\s")
_SPACE = np.array([chr(c).isspace() for c in range(0x110000)])
#: Characters that str and the patterns don't both take for white space.
_UNSURE = np.array([bool(s) != bool(_BLANK.match(chr(c))) for c, s in enumerate(_SPACE[:0x3001])] + [False] * (0x110000 - 0x3001))


class Words(dict):
    """Numbers of the words met, each of which is tokenized once: no token holds white space, and the only thing that a
    token depends on beyond its word is whether a capital opens the next one, after a capital and a period (the key (word,
    True)). Tokens of all words lie in columns: n and first by word; texts, starts, sizes, kinds, known by token."""

    MOST_WORDS, MOST_CHARS = 300_000, 8_000_000

    def __init__(self, lexicon: dict | None = None):
        super().__init__()
        self.lexicon, self.chars, self.texts = lexicon or {}, 0, []
        self.columns = [array("q") for _ in range(8)]

    # views of the columns, to be let go before a word is added
    n, first, dotted, upper, starts, sizes, kinds, known = (property(lambda self, k=k: np.frombuffer(self.columns[k], np.int64)) for k in range(8))

    @staticmethod
    def pieces(word: str) -> list[tuple[str, int, int, str]]:
        """tokenize of a word; of plain letters, with or without a mark behind them, without the pattern."""
        core = word[:-1]
        if word < "ɐ" and max(word) < "ɐ":
            if word.isalpha():
                return [(word, 0, len(word), "word")]
            if len(core) > 1 and word[-1] in ".,;:!?" and core.isalpha() and not (word[-1] == "." and core in ABBREVIATIONS):
                return [(core, 0, len(core), "word"), (word[-1], len(core), len(word), "punct")]
        return tokenize(word, 0, len(word))

    def __missing__(self, key):
        word, before_capital = key if isinstance(key, tuple) else (key, False)
        found = tokenize(word + " A", 0, len(word) + 2)[:-1] if before_capital else self.pieces(word)
        number = self[key] = len(self)
        self.chars += len(word)
        n, first, dotted, upper, starts, sizes, kinds, known = self.columns
        n.append(len(found))
        first.append(len(self.texts))
        dotted.append(not before_capital and word[-1] == "." and bool(_UPPER.fullmatch(word[-2:-1])))
        upper.append(not "a" <= word[0] <= "z" and bool(_UPPER.match(word)))
        for text, a, b, kind in found:
            self.texts.append(text)
            starts.append(a)
            sizes.append(b - a)
            kinds.append(KINDS.index(kind))
            known.append(kind in ASKABLE and self.lexicon.get(text) is not None)
        return number

    def full(self) -> bool:
        return len(self) > self.MOST_WORDS or self.chars > self.MOST_CHARS


def segment_words(text: str, words: Words, max_askable: int = CHUNK_ASKABLE) -> tuple | None:
    """segment_text by known words, in columns: sentences (starts, ends), tokens (number in words, start, end, sentence,
    chunk) and chunks. None if the text has a character that may or may not be white space."""
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if _UNSURE[chars].any():
        return None
    none = np.zeros(0, np.int64)
    bounds = split_sentences(text)
    if not bounds:
        return (none, none), (none,) * 5, []
    ink = ~_SPACE[chars]
    at = np.flatnonzero(ink & ~np.concatenate(([False], ink[:-1])))
    split = text.split()
    ids = np.array(list(map(words.__getitem__, split)))
    a, b = np.array(bounds).T
    inside = np.searchsorted(a, at, "right") - 1
    for i in np.flatnonzero(words.dotted[ids[:-1]] & words.upper[ids[1:]] & (inside[:-1] == inside[1:])):
        ids[i] = words[split[i], True]
    n = words.n[ids]
    last = np.cumsum(n)
    token = np.repeat(words.first[ids] - (last - n), n) + np.arange(last[-1])
    start = np.repeat(at, n) + words.starts[token]
    end = start + words.sizes[token]
    own = np.repeat(inside, n)
    askable = words.kinds[token] < len(ASKABLE)
    asked = np.cumsum(askable)
    fresh = np.concatenate(([True], own[1:] != own[:-1]))
    opening = np.flatnonzero(fresh)
    asked_in = asked - (asked[opening] - askable[opening])[own]
    part = np.maximum(asked_in - 1, 0) // max_askable
    opens = fresh | np.concatenate(([False], part[1:] != part[:-1]))
    head = np.flatnonzero(opens)
    sentence = np.cumsum(opens) - 1
    starts = np.where(fresh[head], a[own[head]], start[head])
    tail = np.concatenate((head[1:] - 1, [len(token) - 1]))
    ends = np.where(np.concatenate((fresh[head[1:]], [True])), b[own[tail]], end[tail])
    per = np.add.reduceat(askable.astype(np.int64), head)
    groups, lo, count = [], 0, 0
    for s, k in enumerate(per.tolist()):
        if count and count + k > max_askable:
            groups.append((lo, s))
            lo, count = s, 0
        count += k
    groups.append((lo, len(per)))
    firsts = [*head.tolist(), len(token)]
    chunk = np.repeat(np.arange(len(groups)), [firsts[e] - firsts[s] for s, e in groups])
    rows = [(f"c{k:04d}", k, int(starts[s]), int(ends[e - 1]), text[starts[s - 1] : ends[s - 1]][-CONTEXT_CHARS:] if s else "", s, e, firsts[s], firsts[e]) for k, (s, e) in enumerate(groups)]
    return (starts, ends), (token, start, end, sentence, chunk), rows


def segment(docs: DataFrame, max_askable: int = CHUNK_ASKABLE, parts: tuple[str, ...] = tuple(TYPES), lexicon: dict | None = None) -> DataFrame:
    """docs (doc_id, text) to one row of arrays a document; a null text has none of anything.

    parts: which arrays are made. lexicon: only tokens of chunks with a word or number that it knows are given out, and
    numbered among themselves.
    """

    def column(name: str, texts: list, found: list, words: Words) -> pa.Array:
        if name == "chunks":
            return struct_lists([f[2] for f in found], TYPES[name])
        slow = {i: segment_text(texts[i], max_askable) for i, f in enumerate(found) if f[1] is None}
        if name == "sentences":
            pairs = [np.array(slow[i][0], np.int64).reshape(-1, 2).T if i in slow else f[0] for i, f in enumerate(found)]
            return lists([len(p[0]) for p in pairs], [np.concatenate([p[k] for p in pairs]) for k in (0, 1)], TYPES[name])
        kept, known = [f[1] for f in found], words.known.astype(bool)
        for i, f in enumerate(kept):
            if i in slow:
                rows = slow[i][1]
                if lexicon is not None:
                    hit = {t[5] for t in rows if t[3] in ASKABLE and lexicon.get(t[0]) is not None}
                    rows = [t for t in rows if t[5] in hit]
                kept[i] = rows
            elif lexicon is not None and len(f[0]):
                token, chunk = f[0], f[4]
                hit = np.zeros(chunk[-1] + 1, bool)
                hit[chunk[known[token]]] = True
                kept[i] = tuple(c[hit[chunk]] for c in f)
        if slow:  # rare: by rows
            texts_of, kinds_of = words.texts, words.kinds
            rows = [f if i in slow else [(texts_of[t], a, b, KINDS[kinds_of[t]], s, f"c{c:04d}") for t, a, b, s, c in zip(*(x.tolist() for x in f), strict=True)] for i, f in enumerate(kept)]
            return struct_lists(rows, TYPES[name])
        token, start, end, sentence, chunk = (np.concatenate([f[k] for f in kept]) for k in range(5))
        names = pa.array([f"c{k:04d}" for k in range(int(chunk.max(initial=-1)) + 1)], _TEXT)
        columns = [pa.array(words.texts, _TEXT).take(pa.array(token)), start, end, pa.array(KINDS).take(pa.array(words.kinds[token])), sentence, names.take(pa.array(chunk))]
        return lists([len(f[0]) for f in kept], columns, TYPES[name])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(lexicon)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo in range(0, len(texts), 200):  # rows that hold their tokens at once
                if words.full():
                    words = Words(lexicon)
                some = texts[lo : lo + 200]
                found = [segment_words(t, words, max_askable) for t in some]
                found = [(None, None, segment_text(t, max_askable)[2]) if f is None else f for f, t in zip(found, some, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(some)), *(column(p, some, found, words) for p in parts)], ["doc_id", *parts])

    schema = ", ".join(["doc_id bigint", *(f"{p} {SEGMENTED[p]}" for p in parts)])
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, schema)


def lists(sizes: list[int], columns: list, fields: list[tuple[str, pa.DataType]]) -> pa.ListArray:
    """Columns as an Arrow column of lists of structs, of these sizes."""
    values = pa.StructArray.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])
    return pa.ListArray.from_arrays(pa.array(list(accumulate(sizes, initial=0)), pa.int32()), values)


def struct_lists(rows: list[list[tuple]], fields: list[tuple[str, pa.DataType]]) -> pa.ListArray:
    """Lists of tuples as an Arrow column of lists of structs, made field by field."""
    flat = [x for r in rows for x in r]
    columns = list(zip(*flat, strict=True)) or [()] * len(fields)
    return lists(list(map(len, rows)), [pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], fields)


def tokens_of(segmented: DataFrame) -> DataFrame:
    """(doc_id, tok_idx, text, start, end, kind, sent_idx, chunk_id), one row a token."""
    rows = segmented.select("doc_id", F.posexplode("tokens").alias("tok_idx", "t"))
    return rows.select("doc_id", "tok_idx", "t.text", "t.start", "t.end", "t.kind", F.col("t.sentence").alias("sent_idx"), "t.chunk_id")
