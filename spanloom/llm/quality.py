"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score(x) = sigmoid(w0 + <w, x> + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]), so that all
pairwise interactions cost time linear in the number of features. It is fitted on the driver on a
sample of at most ``sample_rows`` labelled documents (a documented bound, chosen by a hash of the
id); only their sparse features travel. The fitted arrays have a fixed size (BUCKETS x (RANK + 1)
numbers), so they go to the tasks with the function, and every text is scored whole, in place,
without a shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.common import byte_batches, held_out, sample_order

WORD_BUCKETS = 1 << 13
STATS = (
    "chars_log", "words_log", "lines_log", "word_chars", "upper", "digit", "symbol", "space", "pipe", "shout",
    "distinct_words", "top_word", "distinct_lines", "words_per_line", "stopped_lines", "comma", "high_bytes",
)
LEVELS = 8
#: Buckets of metadata values.
META_BUCKETS = 1 << 10
#: Words, one weight for each statistic, one for each level of each statistic, metadata.
META_START = WORD_BUCKETS + len(STATS) * (1 + LEVELS)
SIZE = META_START + META_BUCKETS
RANK = 8
THRESHOLD = 0.7
SAMPLE_ROWS = 6000
EPOCHS = 30
#: Share of the Euclidean length that a document's words have, and its metadata; the rest is structure.
WORD_WEIGHT, META_WEIGHT = 0.5, 0.2

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[i for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in ".,;:'\"-()"]] = True


def statistics(text: str, counts: Counter[str], n_words: int) -> np.ndarray:
    """The STATS of a text; zeros for an empty one."""
    if not text:
        return np.zeros(len(STATS))
    b = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    n = max(int(b.sum()), 1)
    letters = max(int(b[65:91].sum() + b[97:123].sum()), 1)
    lines = [x for x in text.split("\n") if x.strip()]
    k, w = max(len(lines), 1), max(n_words, 1)
    return np.array([
        np.log1p(len(text)), np.log1p(n_words), np.log1p(len(lines)), min(len(text) / w, 40) / 10,
        b[65:91].sum() / letters, b[48:58].sum() / n, b[SYMBOLS].sum() / n, b[[9, 10, 13, 32]].sum() / n, b[124] / n * 10, b[33] / n * 10,
        len(counts) / w, max(counts.values(), default=0) / w, len(set(lines)) / k, np.log1p(w / k), sum(x.rstrip().endswith((".", "!", "?")) for x in lines) / k, b[44] / n * 10, b[128:].sum() / n,
    ])


def words_of(text: str, bucket: dict[str, int]) -> tuple[Counter[str], int, np.ndarray, np.ndarray]:
    """Counts of the lower-case words, how many there are, and the hashed log counts, scaled to WORD_WEIGHT."""
    counts = Counter(text.lower().split())
    if len(bucket) > 300_000:  # memory only: the hash of a word is always the same
        bucket.clear()
    at = np.empty(len(counts), np.int64)
    for i, word in enumerate(counts):
        if (k := bucket.get(word)) is None:
            k = bucket[word] = xxhash.xxh64_intdigest(word) % WORD_BUCKETS
        at[i] = k
    value = np.log1p(np.fromiter(counts.values(), float, len(counts)))
    ids, inverse = np.unique(at, return_inverse=True)
    summed = np.bincount(inverse, value, len(ids)) if len(ids) else np.zeros(0)
    return counts, sum(counts.values()), ids, summed * (WORD_WEIGHT / max(np.linalg.norm(summed), 1e-9))


def metadata(docs: DataFrame, columns: tuple[str, ...]) -> Column:
    """An array with one value for each metadata column: numbers by their quarter octave, others as text; nulls apart."""

    def value(c: str) -> Column:
        kind = docs.schema[c].dataType
        number = F.col(f"`{c}`").cast("double")
        level = F.concat(F.when(number < 0, "-").otherwise(""), F.floor(4 * F.log2(F.abs(number) + 1)).cast("string"))
        return F.concat(F.lit(f"{c}="), F.coalesce(level if isinstance(kind, T.NumericType) else F.col(f"`{c}`").cast("string"), F.lit("\0")))

    return F.array(*map(value, columns)).cast("array<string>")


def meta_features(values: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a document's metadata, scaled to META_WEIGHT."""
    found = Counter(META_START + xxhash.xxh64_intdigest(v) % META_BUCKETS for v in values)
    ids, n = np.array(sorted(found), np.int64), np.array([found[i] for i in sorted(found)], float)
    return ids, n * (META_WEIGHT / max(np.linalg.norm(n), 1e-9))


@dataclass
class FactorisationMachine:
    mean: np.ndarray  # of the statistics
    scale: np.ndarray
    cuts: np.ndarray  # STATS x (LEVELS - 1)
    w0: float
    w: np.ndarray
    v: np.ndarray
    columns: tuple[str, ...] = ()  # of metadata

    def features(self, stats: np.ndarray, word_ids: np.ndarray, word_values: np.ndarray, meta: list[str]) -> tuple[np.ndarray, np.ndarray]:
        meta_ids, meta_values = meta_features(meta)
        z = np.clip((stats - self.mean) / self.scale, -4, 4) / np.sqrt(len(STATS))
        level = WORD_BUCKETS + len(STATS) + np.arange(len(STATS)) * LEVELS + (stats[:, None] > self.cuts).sum(1)
        return np.concatenate([word_ids, WORD_BUCKETS + np.arange(len(STATS)), level, meta_ids]), np.concatenate([word_values, z, np.full(len(STATS), 1 / np.sqrt(len(STATS))), meta_values])

    def logit(self, ids: np.ndarray, x: np.ndarray) -> float:
        v = self.v[ids] * x[:, None]
        s = v.sum(0)
        return float(self.w0 + self.w[ids] @ x + 0.5 * (s @ s - (v * v).sum()))


def fit(stats: np.ndarray, word_rows: list[tuple[np.ndarray, np.ndarray, list[str]]], y: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> FactorisationMachine:
    """Adam on the logistic loss with weight decay, one mini-batch of 64 rows at a time.

    With no labelled row the machine has no weights and scores everything 0.5; with one class only it
    learns the intercept of that class.
    """
    rng = np.random.default_rng(seed)
    zeros = np.zeros((0, len(STATS)))
    stats = stats if len(y) else zeros
    mean, scale = (stats.mean(0), stats.std(0) + 1e-3) if len(y) else (np.zeros(len(STATS)), np.ones(len(STATS)))
    cuts = np.quantile(stats, np.arange(1, LEVELS) / LEVELS, axis=0).T if len(y) else np.zeros((len(STATS), LEVELS - 1))
    fm = FactorisationMachine(mean, scale, cuts, 0.0, np.zeros(SIZE), rng.normal(0, 0.05, (SIZE, RANK)))
    if not len(y):
        return fm
    share = np.clip(y.mean(), 0.02, 0.98)
    fm.w0 = float(np.log(share / (1 - share)))
    rows = [fm.features(s, *w) for s, w in zip(stats, word_rows, strict=True)]
    p = np.concatenate([fm.v, fm.w[:, None]], axis=1)
    decay = np.array([1e-3] * RANK + [1e-4])
    m, u = np.zeros_like(p), np.zeros_like(p)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), 64):
            step += 1
            batch = order[at : at + 64]
            sizes = np.array([len(rows[i][0]) for i in batch])
            starts = np.cumsum(sizes) - sizes
            ids, x = (np.concatenate([rows[i][k] for i in batch]) for k in (0, 1))
            px = p[ids] * x[:, None]  # the last column is the linear part
            sums = np.add.reduceat(px, starts)
            squares = np.add.reduceat((px[:, :RANK] ** 2).sum(1), starts)
            logit = fm.w0 + sums[:, RANK] + 0.5 * ((sums[:, :RANK] ** 2).sum(1) - squares)
            e = 1 / (1 + np.exp(-logit)) - y[batch]
            fm.w0 -= 0.002 * e.sum()
            slope = np.repeat(sums, sizes, axis=0) - px
            slope[:, RANK] = 1
            slope *= (np.repeat(e, sizes) * x)[:, None]
            cell = ids[:, None] * (RANK + 1) + np.arange(RANK + 1)
            g = np.bincount(cell.ravel(), slope.ravel(), p.size).reshape(p.shape) / len(batch) + decay * p
            m += 0.1 * (g - m)
            u += 0.001 * (g * g - u)
            p -= 0.02 / (1 - 0.9**step) * m / (np.sqrt(u / (1 - 0.999**step)) + 1e-8)
    fm.v, fm.w = np.ascontiguousarray(p[:, :RANK]), np.ascontiguousarray(p[:, RANK])
    return fm


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", meta_cols: tuple[str, ...] = ()) -> FactorisationMachine:
    """Fit on at most sample_rows labelled documents outside the held-out quarter.

    meta_cols: columns of docs that count as metadata, each value hashed into a bucket. Rows of labels
    with a null id or label are ignored; of several labels of an id the largest counts. An id that docs
    repeats counts once for each of its texts, and once for each text with other metadata.
    """
    byte_batches(docs.sparkSession)
    chosen = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("label")).where("id is not null and label is not null").where(~held_out("id")).groupBy("id").agg(F.max("label").alias("label")).orderBy(sample_order("id"), "id").limit(sample_rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket: dict[str, int] = {}
        for batch in batches:
            out = []
            for text, label in zip(batch["text"], batch["label"], strict=True):
                counts, n, ids, values = words_of(text or "", bucket)
                out.append((statistics(text or "", counts, n), ids.astype(np.int32).tobytes(), values.tobytes(), label))
            yield pd.DataFrame(out, columns=["stats", "ids", "vals", "label"]).assign(meta=list(batch["meta"]), id=batch["id"], hash=batch["hash"])

    found = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"), metadata(docs, meta_cols).alias("meta")).withColumn("hash", F.xxhash64("text"))
    found = found.join(F.broadcast(chosen), "id").mapInPandas(run, f"stats array<double>, ids binary, vals binary, label int, meta array<string>, id {found.schema['id'].dataType.simpleString()}, hash bigint")
    found = found.dropDuplicates(["id", "hash", "meta"]).orderBy(sample_order("id"), "id", "hash", "meta").limit(sample_rows)  # ids may repeat
    rows = found.collect()
    rows.sort(key=lambda r: (r["label"], r["stats"], r["meta"]))  # the same machine whatever the order of the partitions
    fm = fit(np.array([r["stats"] for r in rows]), [(np.frombuffer(r["ids"], np.int32), np.frombuffer(r["vals"]), r["meta"]) for r in rows], np.array([r["label"] for r in rows], float))
    fm.columns = tuple(meta_cols)
    return fm


def score_documents(docs: DataFrame, machine: FactorisationMachine, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with score (0 to 1, higher: better) and predicted (1 if score >= threshold).

    Null and empty texts have no words and zero statistics and get the score of that and their
    metadata. Columns named score or predicted are replaced; all others, and repeated rows, stay.
    """
    byte_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        bucket: dict[str, int] = {}
        for texts, metas in parts:
            out = np.empty(len(texts))
            for i, (text, meta) in enumerate(zip(texts, metas, strict=True)):
                counts, n, ids, values = words_of(text or "", bucket)
                out[i] = machine.logit(*machine.features(statistics(text or "", counts, n), ids, values, list(meta)))
            yield pd.Series(1 / (1 + np.exp(-np.clip(out, -30, 30))))

    scored = docs.withColumn("score", score(F.col(f"`{text_col}`").cast("string"), metadata(docs, machine.columns)))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
