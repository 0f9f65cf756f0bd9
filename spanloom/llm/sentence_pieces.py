"""SentencePiece encoding and decoding through a distinct-chunk table.

No piece of the vocabulary holds a white-space marker after another character, so no merge crosses
the left edge of a marked word (a run of markers and what follows up to the next marker). A text is
therefore the concatenation of its marked words, each segmented on its own. Every task keeps a table
of the distinct marked words it has met, has the library segment each of them once, and puts the ids
back by position with one vectorised gather; the table starts afresh when it reaches
``TABLE_LIMIT`` entries, which bounds memory and never changes a result. Nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import byte_batches

MODEL = "piece_bpe_32k.model"
MARK = "▁"
TABLE_LIMIT = 300_000
#: Characters of text handled at once.
SLICE_CHARS = 500_000
MARKED_WORD = re.compile(f"{MARK}+[^{MARK}]*")


class ChunkTable:
    """Ids of the distinct marked words met so far, as one flat array with offsets."""

    def __init__(self, model_path: str, limit: int = TABLE_LIMIT):
        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        crossing = [p for p in map(self.sp.id_to_piece, range(self.sp.vocab_size())) if MARK in p.lstrip(MARK)]
        if crossing:
            raise ValueError(f"pieces cross white-space markers, e.g. {crossing[0]!r}: marked words can't be segmented alone")
        self.limit = limit
        self._reset()

    def _reset(self) -> None:
        self.code: dict[str, int] = {}
        self.flat = np.array([self.sp.eos_id()], dtype=np.int32)  # code 0: the end id
        self.start, self.length = np.array([0]), np.array([1])

    def _add(self, fresh: list[str]) -> None:
        alone = self.sp.piece_to_id(MARK)
        # the library puts one marker in front of each input itself, but none in front of ""
        ids = [x or [alone] for x in self.sp.encode([c[1:] for c in fresh], num_threads=1)]
        length = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        start = len(self.flat) + np.cumsum(length) - length
        self.code.update(zip(fresh, range(len(self.start), len(self.start) + len(fresh)), strict=True))
        self.flat = np.concatenate([self.flat, np.fromiter((i for x in ids for i in x), dtype=np.int32, count=int(length.sum()))])
        self.start, self.length = np.concatenate([self.start, start]), np.concatenate([self.length, length])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each closed by the end id, and the offsets of the texts in them."""
        if len(self.code) > self.limit:
            self._reset()
        split = [MARKED_WORD.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if fresh := list(dict.fromkeys(c for chunks in split for c in chunks if c not in self.code)):
            self._add(fresh)
        code, get = [], self.code.__getitem__
        for chunks in split:
            code.extend(map(get, chunks))
            code.append(0)
        code = np.array(code, dtype=np.int64)
        length = self.length[code]
        ends = np.cumsum(length)
        ids = self.flat[np.arange(int(length.sum())) + np.repeat(self.start[code] - (ends - length), length)]
        last = np.cumsum([len(c) + 1 for c in split]) - 1
        return ids, np.concatenate([[0], ends[last]]).astype(np.int64)


def slices(texts: list[str], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of at most so many characters, or of one text."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > limit:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def encode_documents(docs: DataFrame, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids, decoded) for each row, in its partition.

    ids: the library's ids of the whole text and the end id; decoded: the library's decode(ids).
    A null text counts as empty (the end id alone). Repeated rows stay repeated; other columns are
    not looked at, whatever their names; an empty table gives an empty one.
    """
    path = model_path or public_tokenizers.path(MODEL)
    byte_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = ChunkTable(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts):
                ids, offsets = chunks.encode(texts[a:b])
                flat, at = ids.tolist(), offsets.tolist()
                decoded = [chunks.sp.decode(flat[x:y]) for x, y in zip(at, at[1:], strict=False)]
                values = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), values, pa.array(decoded, pa.string())], ["id", "ids", "decoded"])

    source = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    out = source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, ids array<int>, decoded string")
    return out.withColumnRenamed("id", id_col)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return encoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
