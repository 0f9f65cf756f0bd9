"""Near-duplicate embeddings: random-hyperplane sign hashing, exact cosines, connected components.

1. Equal vectors are one class; only one vector of each class goes on (a hot vector costs one row).
2. Each table of random hyperplanes gives a class a sign code. The number of planes grows with the
   logarithm of the number of classes (buckets keep their size), and the number of tables follows
   from it: a pair whose cosine is just 0.9 shares the code of a table with probability
   p = (1 - acos(0.9)/pi)^planes, and (1 - p)^tables is at most MISS. Closer pairs meet more surely.
3. The vectors of a bucket are compared block by block with one matrix product: a bucket of any size
   is cut into blocks of BLOCK rows, and pairs of blocks are dealt over many cells, so no bucket has
   a cap and none lands in one task. A pair counts only in the first table in which it meets.
   Blocks emit, not pairs, but for each vector its number of links there, and a spanning forest.
4. Links are summed for each class; components come from min-label propagation with pointer jumping
   over the forest edges.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import cut, shuffle_width
from spanloom.operators.components import connected_components

MIN_COSINE, MISS, BLOCK = 0.9, 2e-4, 2048
#: Vectors of a bucket on average, if they lay evenly; rows that one cell compares.
BUCKET_ROWS, CELL_ROWS = 256, 20_000
LEAST_PLANES = 8


def plan_tables(classes: int, min_cosine: float = MIN_COSINE, miss: float = MISS) -> tuple[int, int]:
    """(tables, planes) for so many different vectors."""
    planes = max(LEAST_PLANES, math.ceil(math.log2(max(classes, 1) / BUCKET_ROWS)))
    return math.ceil(math.log(miss) / math.log1p(-((1 - math.acos(min_cosine) / math.pi) ** planes))), planes


@functools.cache
def hyperplanes(dim: int, tables: int, planes: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, tables * planes))


def sign_codes(x: np.ndarray, tables: int, planes: int) -> np.ndarray:
    signs = (x @ hyperplanes(x.shape[1], tables, planes) >= 0).reshape(len(x), tables, planes)
    return signs @ (1 << np.arange(planes, dtype=np.int64))


def spanning(i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the pairs."""
    root: dict[int, int] = {}

    def find(k: int) -> int:
        while (up := root.setdefault(k, k)) != k:
            root[k] = root[up]
            k = root[k]
        return k

    out = []
    for p, q in zip(i.tolist(), j.tolist(), strict=True):
        if (r := find(p)) != (s := find(q)):
            root[s] = r
            out.append((p, q))
    return out


def near_duplicates(vectors: DataFrame, min_cosine: float = MIN_COSINE, miss: float = MISS, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id_col, n_links, component_id, kept) for each row.

    Vectors that are null, empty, zero, or hold a null or non-finite component link with nothing and
    are components of their own; so are vectors of another length towards each other. Rows with equal
    vectors link with each other. Rows that repeat an id and a vector stay repeated and count as one
    another's links; null ids are kept but form no links. Other columns are not read.
    """
    source = vectors.select(vectors[id_col].alias("id"), vectors[vector_col].cast("array<double>").alias("v"))
    usable = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0) & F.col("id").isNotNull(), F.lit(False))
    # 0.0 and -0.0 are one value in a group; the hash only names a class, equality decides
    rows = source.where(usable).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    classes = cut(rows.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("n")))
    n_classes = classes.count()
    tables, planes = plan_tables(n_classes, min_cosine, miss)

    def buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby(batch["v"].map(len)):
                codes = sign_codes(np.stack(part["v"]), tables, planes)
                for lo in range(0, len(part), 1000):
                    c = codes[lo : lo + 1000]
                    yield pd.DataFrame({"rep": np.repeat(part["rep"].to_numpy()[lo : lo + 1000], tables), "bucket": (c + (np.arange(tables) << planes)).ravel() + (int(dim) << 40)})

    id_type = source.schema["id"].dataType.simpleString()
    entries = classes.select("rep", "v").mapInPandas(buckets, f"rep {id_type}, bucket bigint")
    # blocks of a bucket: rows are dealt by a hash of the id, so a block needs no ordering of its bucket
    sizes = entries.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    blocks = F.ceil(F.col("size") / block).cast("int")
    dealt = entries.join(sizes, "bucket").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    tasks = dealt.select("rep", "bucket", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tasks = tasks.select("rep", "bucket", "own", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))
    cells = max(shuffle_width(vectors.sparkSession), 2 * n_classes * tables // CELL_ROWS)
    members = tasks.join(classes.select("rep", "v", "n"), "rep").withColumn("cell", F.pmod(F.xxhash64("bucket", "a", "b"), F.lit(cells)))

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["bucket", "a", "b"], kind="stable")
        keys = part[["bucket", "a", "b"]].to_numpy()
        rep, n, own = (part[c].to_numpy() for c in ("rep", "n", "own"))
        count, forest = np.zeros(len(part), np.int64), []
        edges = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1), [True]]))
        for lo, hi in zip(edges, edges[1:], strict=False):
            (bucket, a, b), here = keys[lo], own[lo:hi]
            left, right = np.flatnonzero(here == a), np.flatnonzero(here == b)
            if len(left) and len(right) and hi - lo > 1:
                x = np.stack(part["v"].iloc[lo:hi])
                for i, j in linked_pairs(x, left, right, int(bucket)):
                    np.add.at(count, lo + i, n[lo + j])
                    np.add.at(count, lo + j, n[lo + i])
                    forest.extend(spanning(lo + i, lo + j))
        found = np.flatnonzero(count)
        ends = np.array(forest, np.int64).reshape(-1, 2)
        return pd.DataFrame({"rep": np.concatenate([rep[found], rep[ends[:, 0]]]), "other": np.concatenate([rep[found], rep[ends[:, 1]]]), "links": np.concatenate([count[found], np.zeros(len(ends), np.int64)])})

    def linked_pairs(x: np.ndarray, left: np.ndarray, right: np.ndarray, bucket: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of the block with a cosine of min_cosine that no earlier table has brought together."""
        table = (bucket >> planes) & ((1 << (40 - planes)) - 1)
        norm = np.sqrt((x * x).sum(1))
        for at in range(0, len(left), 256):
            rows = left[at : at + 256]
            i, j = np.nonzero((x[rows] @ x[right].T) / (norm[rows][:, None] * norm[right]) >= min_cosine - 1e-12)
            i, j = rows[i], right[j]
            once = i < j if left is right or (left[0] == right[0]) else i != j
            i, j = i[once], j[once]
            exact = np.einsum("ij,ij->i", x[i], x[j]) / (norm[i] * norm[j]) >= min_cosine
            i, j = i[exact], j[exact]
            if len(i):
                used, place = np.unique(np.concatenate([i, j]), return_inverse=True)
                codes = sign_codes(x[used], tables, planes)[:, :table]
                new = ~(codes[place[: len(i)]] == codes[place[len(i) :]]).any(1)
                yield i[new], j[new]

    found = cut(members.groupBy("cell").applyInPandas(compare, f"rep {id_type}, other {id_type}, links bigint"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    component = connected_components(found.where("links = 0").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    known = classes.join(links, "rep", "left").join(component.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select(F.col("v").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = source.withColumn("v", F.when(usable, F.transform("v", lambda x: x + F.lit(0.0)))).join(known, F.col("v") == F.col("class"), "left")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "id") == F.col("id"), F.lit(True)).alias("kept"),
    )
