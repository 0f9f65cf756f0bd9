"""Language identification by unigram pieces, marginalised over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a
word in a language is the sum over all its segmentations into pieces (a forward algorithm), and a
text's is the product over its words. Piece counts come from the library's segmentation of the
distinct words of a bounded sample of labelled documents; scoring looks at every word of every text.
Words are lower-cased runs of letters with a leading marker; those of a length are scored together, and
long ones by the same recursion with rescaled sums, so a word of any length is scored whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import public_tokenizers
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import byte_batches, held_out, sample_order

MODEL = "piece_bpe_32k.model"
LETTERS = regex.compile(r"\p{L}+")
#: Letters up to which the sums of a word fit in a double (each at least FLOOR); kept entries of the word table.
PLAIN_CHARS, KEPT_CHARS = 32, 64
SAMPLE_ROWS = 6000
#: Added to each piece's count, and the share of a character that is no piece.
ALPHA, FLOOR = 0.1, 1e-8
TABLE_LIMIT = 500_000
UNKNOWN = "und"


def vocabulary(path: str) -> dict[str, int]:
    """Ordinary pieces (bytes, controls and the unknown piece apart)."""
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return {sp.id_to_piece(i): i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i))}


class PieceTable:
    """Finds pieces by 64-bit rolling hashes of code points, whole arrays at a time: two hash tables,
    the second for the few pieces whose slot in the first is taken."""

    BASE, MIX, BITS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), 21

    def __init__(self, pieces: dict[str, int]):
        self.longest = max(map(len, pieces))
        size = max(pieces.values()) + 1
        self.key = np.zeros(size + 1, np.uint64)
        self.none = size
        self.tables = [np.full(1 << self.BITS, size, np.int32) for _ in range(2)]
        for piece, i in pieces.items():
            h = np.zeros(1, np.uint64)
            for c in piece:
                h = self.grow(h, np.uint64(ord(c)))
            self.key[i] = h[0]
            for k in (0, 1):
                if self.tables[k][slot := self.slot(h, k)[0]] == size:
                    self.tables[k][slot] = i
                    break
            else:
                raise ValueError("two pieces share both slots")

    def grow(self, h: np.ndarray, code: np.ndarray) -> np.ndarray:
        return (h + code + np.uint64(1)) * self.BASE

    def slot(self, h: np.ndarray, k: int) -> np.ndarray:
        x = (h ^ (h >> np.uint64(29))) * self.MIX if k == 0 else (h ^ (h >> np.uint64(31))) * self.BASE
        return (x >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, h: np.ndarray, otherwise: int) -> np.ndarray:
        ids = self.tables[0][self.slot(h, 0)]
        miss = np.flatnonzero(self.key[ids] != h)
        again = self.tables[1][self.slot(h.ravel()[miss], 1)]
        again[self.key[again] != h.ravel()[miss]] = otherwise
        ids.ravel()[miss] = again
        return ids


def words_of(text: str) -> Counter[str]:
    return Counter(LETTERS.findall(text.lower()))


@dataclass
class LanguageModel:
    langs: list[str]
    prob: np.ndarray  # (vocabulary + 2) x langs; the last two rows: a lone unknown character, nothing
    path: str
    pieces: PieceTable | None = None

    def __getstate__(self):
        return {"langs": self.langs, "prob": self.prob, "path": self.path, "pieces": None}

    def log_prob(self, words: list[str]) -> np.ndarray:
        """Log probability of each word in each language: the forward algorithm, words of a length together."""
        self.pieces = self.pieces or PieceTable(vocabulary(self.path))
        out = np.zeros((len(words), len(self.langs)))
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(len(w), []).append(i)
        unknown, nothing = len(self.prob) - 2, len(self.prob) - 1
        for n, rows in by_length.items():
            n += 1
            if n > PLAIN_CHARS:
                for r in rows:
                    out[r] = self.long_word("▁" + words[r])
                continue
            for at in range(0, len(rows), 2048):
                part = rows[at : at + 2048]
                code = np.ascontiguousarray(np.frombuffer("".join("▁" + words[r] for r in part).encode("utf-32-le"), np.uint32).reshape(len(part), n).T, np.uint64)
                h, ids = np.zeros_like(code), []
                for length in range(1, min(self.pieces.longest, n) + 1):
                    h = self.pieces.grow(h[: n - length + 1], code[length - 1 :])
                    ids.append(self.pieces.find(h, unknown if length == 1 else nothing))
                alpha = np.zeros((n + 1, len(part), len(self.langs)))
                alpha[0] = 1
                for i in range(1, n + 1):
                    for length in range(1, min(len(ids), i) + 1):
                        alpha[i] += alpha[i - length] * self.prob[ids[length - 1][i - length]]
                out[part] = np.log(alpha[n])
        return out


    def long_word(self, word: str) -> np.ndarray:
        """The same sums with only those of the last letters kept, divided by their largest as they go."""
        unknown, nothing = len(self.prob) - 2, len(self.prob) - 1
        code = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64)
        longest = min(self.pieces.longest, len(code))
        h, ids = np.zeros_like(code), np.full((len(code), longest), nothing)  # of the pieces that end with a letter, shortest first
        for length in range(1, longest + 1):
            h = self.pieces.grow(h[: len(code) - length + 1], code[length - 1 :])
            ids[length - 1 :, length - 1] = self.pieces.find(h, unknown if length == 1 else nothing)
        last, log = np.zeros((longest, len(self.langs))), np.zeros(len(self.langs))  # newest first
        last[0] = 1
        for row in ids:
            total = (last * self.prob[row]).sum(0)
            last[1:] = last[:-1]
            last[0] = total
            top = last.max(0)
            last /= top
            log += np.log(top)
        return log + np.log(last[0])


def train(docs: DataFrame, model_path: str | None = None, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Piece probabilities from at most sample_rows labelled documents outside the held-out quarter, chosen by a hash of the id.

    Rows with a null text or lang are ignored. At most sample_rows languages can come out.
    """
    byte_batches(docs.sparkSession)
    path = model_path or public_tokenizers.path(MODEL)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang")).where("text is not null and lang is not null").where(~held_out("id"))
    chosen = rows.select("id").distinct().orderBy(sample_order("id"), "id").limit(sample_rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        for batch in batches:
            counts: dict[tuple[str, int], int] = {}
            for lang, part in batch.groupby("lang"):
                words = sum(map(words_of, part["text"]), Counter())
                for ids, n in zip(sp.encode(list(words), num_threads=1), words.values(), strict=True):
                    for i in ids:
                        counts[lang, i] = counts.get((lang, i), 0) + n
            yield pd.DataFrame([(a, b, n) for (a, b), n in counts.items()], columns=["lang", "piece", "n"])

    counted = rows.join(F.broadcast(chosen), "id").mapInPandas(run, "lang string, piece int, n bigint").groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect()  # at most languages x vocabulary rows
    langs = sorted({r["lang"] for r in counted})
    pieces = vocabulary(path)
    size = sentencepiece.SentencePieceProcessor(model_file=path).vocab_size()
    count = np.zeros((size, len(langs)))
    at = {x: k for k, x in enumerate(langs)}
    for r in counted:
        count[r["piece"], at[r["lang"]]] += r["n"]
    real = np.zeros(size, bool)
    real[list(pieces.values())] = True
    count = (count + ALPHA) * real[:, None]
    prob = np.concatenate([count / np.maximum(count.sum(0), 1e-9), np.full((1, len(langs)), FLOOR), np.zeros((1, len(langs)))])
    return LanguageModel(langs, prob, path)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score) for each row; score: the language's posterior under equal priors.

    Null texts, texts without a letter, and all texts when no language was learned get `und` and 0.
    Ties go to the first language in order. Repeated rows stay repeated; other columns aren't read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at: dict[str, int] = {}
        table = np.zeros((0, len(model.langs)))
        long: list[str] = []  # words too long to be kept in memory
        for batch in batches:
            preds, scores = [], []
            for lo in range(0, len(batch), 512):
                counts = [words_of(t) if t is not None else Counter() for t in batch["text"].iloc[lo : lo + 512]]
                if len(table) > TABLE_LIMIT:  # memory only: a word's probability is always the same
                    at, table = {}, table[:0]
                if model.langs and (fresh := list(dict.fromkeys(w for c in counts for w in c if w not in at))):
                    at.update(zip(fresh, range(len(table), len(table) + len(fresh)), strict=True))
                    table = np.concatenate([table, model.log_prob(fresh)])
                    long.extend(w for w in fresh if len(w) > KEPT_CHARS)
                for c in counts:
                    if not c or not model.langs:
                        preds.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    total = np.fromiter(c.values(), float, len(c)) @ table[np.fromiter((at[w] for w in c), np.int64, len(c))]
                    best = int(total.argmax())
                    preds.append(model.langs[best])
                    scores.append(float(1 / np.exp(np.maximum(total - total[best], -700)).sum()))
                for w in long:
                    del at[w]
                long.clear()
            yield pd.DataFrame({"id": batch["id"], "lang_pred": preds, "score": scores})

    byte_batches(docs.sparkSession)
    source = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    out = source.mapInPandas(run, f"id {source.schema['id'].dataType.simpleString()}, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)
