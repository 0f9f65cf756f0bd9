"""Near-duplicate documents by Order MinHash, verified by banded alignment.

1. Equal texts are one class, named by their MD5; only class representatives are compared.
2. A text's five-word shingles are labelled with their occurrence number, which makes them distinct.
   Each of SKETCHES hash orders picks the PICKS smallest ones and hashes them *in text order*: texts
   agree on such a key if they share those shingles in the same order. With a share J of their shingles
   in common a key agrees with probability J^3, and no key of 16 with (1 - J^3)^16: < 1e-5 for 0.8,
   2 % for 0.6, 12 % for 0.5, 35 % for 0.4.
3. Two texts are linked if they share a key and (a) their shingles align to SIMILARITY, or (b) at least
   SHARED of their shingles are in common and the edit similarity of their *words* is SIMILARITY: one
   changed word costs five shingles, so scattered edits end (a) long before the texts differ much.
4. First each text of a key is aligned with the key's leader only, the most central text (that of the
   largest keys). Keys that still hold several components then are searched whole, one key for each
   set of texts, in blocks of BLOCK_SHINGLES: a block is compared with each block of its key that could
   hold a link, not with those of its own component or of other lengths. One task holds two blocks,
   counts the shingles their texts share, aligns what can be similar and is not joined yet, and returns
   a spanning forest of the links: no row is made for a pair and no text of a key is left out.
5. Alignment of shingles: the longest common subsequence of the two sequences without their labels (a
   copy of a passage may match any other copy), inside the band that a similarity of 0.8 leaves, as a
   longest increasing subsequence of all matched positions; with bit vectors where a text repeats itself
   so much that these are many. similarity = common / (n + m - common). Of words: 1 - edits / longer
   length, with bit vectors. Labelled shingles in common count what two texts share as multisets, which
   bounds the alignment.
6. Components of the links are the groups; the smallest doc_id of a group stays.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import byte_batches, cut
from spanloom.operators.components import connected_components

SHINGLE_WORDS, SIMILARITY = 5, 0.8
#: Share of the shingles that two texts must have in common (of those of either) for their words to be aligned.
SHARED = 0.4
SKETCHES, PICKS = 16, 3
#: Hashes of one step of sketching a long text.
STEP_HASHES = 2_000_000
#: Size of a block, in words with TEXT_WEIGHT more for each text; texts from which a component has blocks of its own.
BLOCK_SHINGLES, TEXT_WEIGHT, OWN_BLOCKS_FROM = 262_144, 64, 32
#: Matched positions, for each shingle of two texts, up to which they are listed.
FEW_MATCHES = 8
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words; emptied when large, which changes no hash."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def word_array(text: str, hashes: WordHashes) -> np.ndarray:
    words = text.split()
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


def shingles_of(words: np.ndarray, k: int = SHINGLE_WORDS) -> np.ndarray:
    """Hashes of the k-word shingles in text order.

    A text of 1 to k - 1 words has one shingle, all its words; one without words has none.
    """
    if not len(words):
        return words
    k = min(k, len(words))
    shingle = np.zeros(len(words) - k + 1, np.uint64)
    for j in range(k):
        shingle = mix(shingle + _STEP + words[j : j + len(shingle)])
    return shingle


def plain_shingles(text: str, hashes: WordHashes, k: int = SHINGLE_WORDS) -> np.ndarray:
    return shingles_of(word_array(text, hashes), k)


def labelled(shingle: np.ndarray) -> np.ndarray:
    """Shingles in text order, each with its occurrence number hashed in."""
    if not len(shingle):
        return shingle
    order = np.argsort(shingle, kind="stable")
    ranked = shingle[order]
    fresh = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    occurrence = np.empty(len(shingle), np.uint64)
    at = np.arange(len(shingle))
    occurrence[order] = at - np.maximum.accumulate(np.where(fresh, at, 0))
    return mix(shingle + _STEP * (occurrence + np.uint64(1)))


def labelled_shingles(text: str, hashes: WordHashes, k: int = SHINGLE_WORDS) -> np.ndarray:
    return labelled(plain_shingles(text, hashes, k))


def sketch_keys(shingles: np.ndarray, sketches: int = SKETCHES, picks: int = PICKS) -> np.ndarray:
    """One key for each hash order: the picks smallest labelled shingles, hashed in text order."""
    n = len(shingles)
    if not n:
        return np.zeros(0, np.int64)
    keys = np.arange(sketches, dtype=np.uint64)
    seeds = (keys + np.uint64(1)) * _STEP
    rows = max(1, STEP_HASHES // n)
    for lo in range(0, sketches, rows):
        part = seeds[lo : lo + rows, None]
        if n > picks:
            chosen = shingles[np.sort(np.argpartition(mix(shingles + part), picks - 1, axis=1)[:, :picks], axis=1)]
        else:
            chosen = np.broadcast_to(shingles, (len(part), n))
        h = keys[lo : lo + rows]
        for j in range(chosen.shape[1]):
            h = mix(h * _STEP + chosen[:, j])
        keys[lo : lo + rows] = h
    return keys.view(np.int64)


def bit_lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence with a bit for each place of b (Hyyro, 2004), however often values repeat."""
    values, inverse, counts = np.unique(b, return_inverse=True, return_counts=True)
    places = dict(zip(values.tolist(), np.split(np.argsort(inverse, kind="stable"), np.cumsum(counts)[:-1]), strict=True))
    masks: dict[int, int] = {}  # of frequent values only, at most len(b) / 64
    every = (1 << len(b)) - 1
    v = every
    for x in a.tolist():
        if (mask := masks.get(x)) is None:
            if (at := places.get(x)) is None:
                continue
            bits = np.zeros(len(b), np.uint8)
            bits[at] = 1
            mask = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
            if len(at) > 64:
                masks[x] = mask
        u = v & mask
        v = ((v + u) | (v - u)) & every
    return len(b) - v.bit_count()


def aligned_similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """common / (n + m - common) of the best alignment in the band; below least, possibly 0. Values may repeat."""
    n, m = len(a), len(b)
    need = least * (n + m) / (1 + least) - 1e-9  # common shingles that the least similarity takes
    if not n or not m or min(n, m) < need:
        return 0.0
    differ = np.flatnonzero(a[: min(n, m)] != b[: min(n, m)])  # an equal start and an equal end are in some longest one
    start = int(differ[0]) if len(differ) else min(n, m)
    a, b = a[start:], b[start:]
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - short :][::-1] != b[len(b) - short :][::-1])
    end = int(differ[0]) if len(differ) else short
    a, b, common = a[: len(a) - end], b[: len(b) - end], start + end
    order = np.argsort(b, kind="stable")
    ranked = b[order]
    lo, hi = np.searchsorted(ranked, a), np.searchsorted(ranked, a, "right")
    counts = hi - lo
    if common + np.count_nonzero(counts) < need:
        return 0.0
    if (matches := int(counts.sum())) > FEW_MATCHES * (n + m):
        common += bit_lcs(a, b)
        return common / (n + m - common)
    # all matched positions, those of one i from the last j to the first, so that only one of them can count
    i = np.repeat(np.arange(len(a)), counts)
    j = order[np.repeat(hi - 1 + np.cumsum(counts) - counts, counts) - np.arange(matches)]
    j = j[np.abs(i - j) <= n + m - 2 * need]  # indels that are left
    tails: list[int] = []
    for x in j.tolist():
        if (at := bisect_left(tails, x)) == len(tails):
            tails.append(x)
        else:
            tails[at] = x
    common += len(tails)
    return common / (n + m - common)


def trimmed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a and b without their equal start and equal end."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    start = int(differ[0]) if len(differ) else n
    a, b, n = a[start:], b[start:], n - start
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    end = int(differ[0]) if len(differ) else n
    return a[: len(a) - end], b[: len(b) - end]


def edit_similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """1 - edits / length of the longer one (Myers, 1999: a bit for each place of a); below least, possibly 0."""
    longest = max(len(a), len(b))
    if not longest:
        return 1.0
    most = (1 - least) * longest + 1e-9
    a, b = trimmed(a, b)
    if abs(len(a) - len(b)) > most:
        return 0.0
    if not len(a) or not len(b):
        return 1 - max(len(a), len(b)) / longest
    (x, m), (y, n) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if max(len(a), len(b)) - int(np.minimum(m[i], n[j]).sum()) > most:  # words that the other one lacks, in any order
        return 0.0
    places: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | 1 << i
    every, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, edits = every, 0, len(a)
    for left, y in zip(range(len(b) - 1, -1, -1), b.tolist(), strict=True):
        equal = places.get(y, 0)
        diagonal = (((equal & up) + up) ^ up) | equal | down
        right_up, right_down = down | ~(diagonal | up) & every, diagonal & up
        edits += bool(right_up & last) - bool(right_down & last)
        if edits - left > most:
            return 0.0
        right_up, right_down = (right_up << 1 | 1) & every, (right_down << 1) & every
        up, down = right_down | ~(diagonal | right_up) & every, right_up & diagonal
    return 1 - edits / longest


def similar(a: np.ndarray, b: np.ndarray, share: float, least: float = SIMILARITY, shared: float = SHARED) -> bool:
    """Whether two texts, as arrays of word hashes, are linked; share: of their labelled shingles in common, of those of either."""
    if share < min(shared, least) - 1e-9:
        return False
    if share >= least - 1e-9 and aligned_similarity(shingles_of(a), shingles_of(b), least) >= least:
        return True
    return share >= shared - 1e-9 and edit_similarity(a, b, least) >= least


def shared_of(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the shingles in common, from sorted labelled shingles of each."""
    if not len(a) or not len(b):
        return 0.0
    at = np.searchsorted(b, a)
    common = np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a)
    return common / (len(a) + len(b) - common)


def forest(nodes: list, texts: list[np.ndarray], components: list, first: np.ndarray, second: np.ndarray, least: float = SIMILARITY, shared: float = SHARED) -> list[tuple]:
    """Links between texts (arrays of word hashes) numbered in first and in second that join everything linked there.

    Texts of one component count as joined. A pair whose shared shingles are too few is not aligned,
    nor is one that other links have joined already.
    """
    parent = {c: c for c in components}

    def root(c):
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    counted = [labelled(shingles_of(x)) for x in texts]  # in common as often as in both
    sizes = np.array([len(x) for x in counted])
    second = second[sizes[second] > 0]
    if not len(second):
        return []
    values = np.unique(np.concatenate(counted))
    held = np.concatenate([np.searchsorted(values, counted[j]) for j in second])
    starts = np.concatenate([[0], np.cumsum(sizes[second])[:-1]])
    has = np.zeros(len(values), bool)
    links = []
    for i in first.tolist():
        at = np.searchsorted(values, counted[i])
        has[at] = True
        common = np.add.reduceat(has[held], starts, dtype=np.int64)
        has[at] = False
        share = common / (sizes[i] + sizes[second] - common)
        likely = np.flatnonzero(share >= min(shared, least) - 1e-9)
        for j, x in zip(second[likely].tolist(), share[likely].tolist(), strict=True):
            p, q = root(components[i]), root(components[j])
            if p != q and similar(texts[i], texts[j], x, least, shared):
                parent[p] = q
                links.append((nodes[i], nodes[j]))
    return links


def block_links(entries: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, shared: float = SHARED) -> DataFrame:
    """Links (a, b) within the keys of entries (key, node, n, c) that hold several components c.

    Keys of two texts are left out: the leader was aligned with the other one. Of keys that hold the
    same texts (equal number, equal sums of two hashes) one is searched.
    """
    none = F.expr("X''")
    several = entries.groupBy("key").agg(
        F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("m"), F.sum(F.col("n") + TEXT_WEIGHT).alias("size"),
        F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"),
    ).where("lo <> hi and m > 2")
    several = several.groupBy("m", "x", "y").agg(F.min("key").alias("key"), F.first("size").alias("size")).select("key", (F.col("size") > BLOCK_SHINGLES).alias("split"))
    # texts that are similar enough are of one length class or of neighbouring ones; 1.001 for rounding
    length = F.when(F.col("split"), F.floor(F.log("n") / F.log(F.lit(1.001 / similarity)))).otherwise(0)
    now = cut(entries.join(several, "key").select("key", "node", "n", "c", "split", length.cast("int").alias("length")))
    own = now.where("split").groupBy("key", "length", "c").agg(F.count("*").alias("m")).where(F.col("m") >= OWN_BLOCKS_FROM)
    now = now.join(own.withColumn("own", F.col("c")).drop("m"), ["key", "length", "c"], "left").withColumn("own", F.coalesce("own", none))
    cells = now.groupBy("key", "length", "own").agg(F.ceil(F.sum(F.col("n") + TEXT_WEIGHT) / BLOCK_SHINGLES).cast("int").alias("blocks"))
    cells = cut(cells)
    members = now.join(cells, ["key", "length", "own"]).withColumn("i", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    members = members.select("key", F.struct("length", "own", "i").alias("block"), "node", "c")
    blocks = cells.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", F.struct("length", "own", "i").alias("block"))
    a, b = blocks.withColumnRenamed("block", "p"), blocks.withColumnRenamed("block", "q")
    near = (F.col("q.length") - F.col("p.length")).isin(0, 1) & (F.col("p") <= F.col("q"))
    met = a.join(b, "key").where(near & ((F.col("p.own") != F.col("q.own")) | (F.col("p.own") == none)))
    sides = met.withColumn("block", F.explode(F.array_distinct(F.array("p", "q"))))
    needed = members.select("node").distinct()

    def arrays(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            yield pd.DataFrame({"node": batch["node"], "words": [word_array(t, hashes).view(np.int64) for t in batch["text"]]})

    def link(group: pd.DataFrame) -> pd.DataFrame:
        words = [np.asarray(x, np.int64).view(np.uint64) for x in group["words"]]
        first, second = np.flatnonzero(group["in_p"]), np.flatnonzero(group["in_q"])
        found = forest(group["node"].tolist(), words, group["c"].tolist(), first, second, similarity, shared)
        return pd.DataFrame(found, columns=["a", "b"])

    sets = texts.join(needed, "node").mapInPandas(arrays, "node binary, words array<bigint>")
    held = members.join(sides, ["key", "block"]).join(sets, "node")
    held = held.select("key", "p", "q", "node", "c", "words", (F.col("block") == F.col("p")).alias("in_p"), (F.col("block") == F.col("q")).alias("in_q"))
    return cut(held.groupBy("key", "p", "q").applyInPandas(link, "a binary, b binary"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, shared: float = SHARED, sketches: int = SKETCHES, picks: int = PICKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, class_id, component_id, kept, text_md5) for each row.

    class_id: smallest id with the same text; component_id: smallest id reachable by links; kept:
    whether the row has that id and, if rows of that id have several texts of the group, the one of
    the smallest MD5. Null texts and rows with a null id link with nothing and are kept. Texts without
    words are duplicates of equal texts only. Rows that repeat id and text stay repeated and share
    their fate. Other columns are not read.
    """
    byte_batches(docs.sparkSession)
    source = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).withColumn("node", F.unhex(F.md5("text")))
    id_type = source.schema["id"].dataType.simpleString()

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            words = [word_array(t, hashes) for t in batch["text"]]
            keys = [sketch_keys(labelled(shingles_of(w)), sketches, picks) for w in words]
            yield pd.DataFrame({"id": batch["id"], "node": batch["node"], "n": [len(w) for w in words], "keys": keys})

    usable = source.where("id is not null and text is not null").select("id", "node", "text")
    sketched = usable.mapInPandas(sketch, f"id {id_type}, node binary, n bigint, keys array<bigint>")
    classes = cut(sketched.groupBy("node").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys")))  # equal texts, equal keys
    entries = classes.select("node", "rep", "n", F.explode("keys").alias("key"))
    met = entries.join(entries.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "key")
    # a text and the keys it shares, at most one for each sketch
    meets = cut(met.groupBy("node").agg(F.first("rep").alias("rep"), F.first("n").alias("n"), F.sum("m").alias("central"), F.collect_list("key").alias("keys")))
    entries = meets.select("node", "n", "central", F.explode("keys").alias("key"))
    needed = meets.select(F.col("rep").alias("id"), "node")
    texts = cut(usable.join(needed, ["id", "node"]).dropDuplicates(["id", "node"]).select("node", "text"))

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()

        def read(text: str) -> tuple[np.ndarray, np.ndarray]:
            words = word_array(text, hashes)
            return words, np.sort(labelled(shingles_of(words)))

        last = ("", *read(""))
        for batch in batches:
            linked = []
            for left, right in zip(batch["left"], batch["right"], strict=True):
                if left != last[0]:
                    last = (left, *read(left))
                words, counted = read(right)
                linked.append(similar(last[1], words, shared_of(last[2], counted), similarity, shared))
            yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "linked": linked})

    def verify(pairs: DataFrame) -> DataFrame:
        """pairs (a, b) with a < b, each once, and whether they are linked."""
        both = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("right")), "b")
        both = both.join(texts.select(F.col("node").alias("a"), F.col("text").alias("left")), "a")
        return cut(both.select("a", "b", "left", "right").mapInPandas(align, "a binary, b binary, linked boolean"))

    def ordered(candidates: DataFrame) -> DataFrame:
        """Each pair (p, q) once, without those whose lengths alone rule the similarity out."""
        fits = F.least("pn", "qn") >= F.lit(similarity) * F.greatest("pn", "qn")
        return candidates.where((F.col("p") != F.col("q")) & fits).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()

    lead = entries.groupBy("key").agg(F.min_by(F.struct("node", "n"), F.struct(-F.col("central"), "node")).alias("q")).select("key", F.col("q.node").alias("q"), F.col("q.n").alias("qn"))
    p = entries.select("key", F.col("node").alias("p"), F.col("n").alias("pn"))
    links = verify(cut(ordered(p.join(lead, "key")))).where("linked").select("a", "b")
    joined = connected_components(links)
    named = joined.withColumnRenamed("component", "c")
    now = meets.join(named, "node", "left").select("node", "n", F.coalesce("c", "node").alias("c"), F.explode("keys").alias("key"))
    more = block_links(now, texts, similarity, shared)
    component = joined if more.isEmpty() else connected_components(links.union(more))

    of = classes.select("node", F.col("rep").alias("class_id")).join(component, "node", "left").withColumn("c", F.coalesce("component", "node"))
    stays = of.groupBy("c").agg(F.min(F.struct("class_id", "node")).alias("least"))
    named = of.join(stays, "c").select("node", "class_id", F.col("least.class_id").alias("component_id"), (F.col("node") == F.col("least.node")).alias("first"))
    out = source.select("id", F.when(F.col("id").isNotNull(), F.col("node")).alias("node"), F.lower(F.hex("node")).alias("text_md5")).join(named, "node", "left")
    component_id = F.coalesce("component_id", "id")
    # copies of the text that stays have other ids
    kept = F.coalesce((component_id == F.col("id")) & F.col("first"), F.lit(True))
    return out.select(F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"), component_id.alias("component_id"), kept.alias("kept"), "text_md5")


def keep_one(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that groups, made of them, doesn't keep; only the ids and hashes of dropped rows are shuffled with docs.

    A row goes by its id and its text together, so other texts of a repeated id stay.
    """
    dropped = groups.where(~F.col("kept")).select(F.col(id_col).alias("_dropped"), F.col("text_md5").alias("_md5")).distinct()
    return docs.join(dropped, (docs[id_col] == dropped["_dropped"]) & (F.md5(docs[text_col].cast("string")) == dropped["_md5"]), "left_anti")
