"""Bottom-k sketches of word-shingle hashes as document fingerprints, in DataFrame functions only.

A sketch is the sorted array of the k smallest distinct 64-bit shingle hashes of a text. Sketches of
parts merge into the sketch of the whole; two of them estimate resemblance and containment, one the
number of distinct shingles. Everything is local to a row but for the neighbour in id order, which
takes one shuffle of the documents by id range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import shuffle_width

K, SHINGLE_WORDS = 128, 5


def word_hashes(text: Column) -> Column:
    """Hashes of the white-space separated words; [] for null or blank texts."""
    return F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def sketch_of(hashes: Column, k: int = K, shingle: int = SHINGLE_WORDS) -> Column:
    """The sketch of a text given as the array of its word hashes (a column, not an expression).

    Fewer words than a shingle make one shingle of all of them; no words, an empty sketch.
    """
    starts = F.slice(hashes, F.lit(1), F.greatest(F.size(hashes) - (shingle - 1), F.lit(0)))
    full = F.transform(starts, lambda x, i: F.xxhash64(x, *(F.get(hashes, i + j) for j in range(1, shingle))))
    few = F.when(F.size(hashes) > 0, F.array(F.xxhash64(hashes))).otherwise(F.array().cast("array<bigint>"))
    return F.slice(F.sort_array(F.array_distinct(F.when(F.size(hashes) >= shingle, full).otherwise(few))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts' shingles together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of the shingle sets, exact while both fit in k; two empty texts: 1."""
    whole = merge(a, b, k)
    return F.when(F.size(whole) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(whole, F.array_intersect(a, b))) / F.size(whole))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k - 1) over the share of the hash range used."""
    used = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / used)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has, from the resemblance and both counts; an empty a: 1."""
    r, na, nb = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(na == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), r * (na + nb) / ((1 + r) * na)))


def as_text(sketch: Column) -> Column:
    return F.lower(F.array_join(F.transform(sketch, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def range_bucket(col: Column, bounds: list) -> Column:
    """How many of the ascending bounds are below the value: a binary search; 0 for null."""
    if not bounds:
        return F.lit(0)
    steps, at = [], 1
    while at <= len(bounds):
        steps.append(at)
        at *= 2
    limits = F.array(*(F.lit(b) for b in bounds))
    found = F.aggregate(F.array(*(F.lit(s) for s in reversed(steps))), F.lit(0), lambda p, s: F.when((p + s <= len(bounds)) & (F.get(limits, p + s - 1) < col), p + s).otherwise(p))
    return F.coalesce(found, F.lit(0))


def with_next(docs: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, Window]:
    """docs with _bucket and _extra, and the window in which lead() gives the next row in descending id.

    Ids are cut into ranges of about equal row counts. Each range also gets a copy (_extra) of the
    first row of the next lower one, and the lowest of the highest one's, so that no window crosses
    ranges; callers drop the copies. Null ids come last; equal ids are ordered by text.
    """
    ranges = 4 * shuffle_width(docs.sparkSession)
    bounds = docs.agg(F.percentile_approx(id_col, [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0] or []
    bounds = sorted(set(bounds))
    cut_up = docs.withColumn("_bucket", range_bucket(F.col(id_col), bounds))
    # at most `ranges` rows: the highest id of each range that has one
    heads = {r[0]: r[1] for r in cut_up.groupBy("_bucket").agg(F.max(id_col)).collect()}
    order = sorted(heads, reverse=True)
    goes_to = [(heads[b], order[i - 1]) for i, b in enumerate(order)]  # order[-1] for the highest: the round closes
    if not goes_to:
        extra = cut_up.limit(0).withColumn("_extra", F.lit(1))
    else:
        id_type = docs.schema[id_col].dataType.simpleString()
        targets = docs.sparkSession.createDataFrame(goes_to, f"_head {id_type}, _to int")
        extra = docs.join(F.broadcast(targets), docs[id_col].eqNullSafe(F.col("_head"))).withColumn("_bucket", F.col("_to")).drop("_head", "_to").withColumn("_extra", F.lit(1))
    both = cut_up.withColumn("_extra", F.lit(0)).unionByName(extra)
    return both, Window.partitionBy("_bucket").orderBy("_extra", F.col(id_col).desc(), F.col("text"))


def edited_pairs(docs: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: its text's sketch, that of its edited text, and their likeness to it and to the next row's.

    Edited: the last floor(n/3) code points replaced by the first as many (or all) of the next row's
    text in descending id order; the last row's next is the first, and a lone row is its own next. A
    null text counts as empty. Rows may repeat; other columns are not read.
    """
    source = docs.select(docs[id_col].alias(id_col), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    rows, near = with_next(source, id_col)
    rows = rows.withColumn("_next", F.coalesce(F.lead("text").over(near), F.lit("")))
    n, third = F.length("text"), (F.length("text") / 3).cast("int")
    rows = rows.select(id_col, "_bucket", "_extra", "text", n.cast("long").alias("n_chars"), F.concat(F.substring("text", F.lit(1), n - third), F.substring("_next", F.lit(1), third)).alias("edited"))
    rows = rows.select("*", word_hashes(F.col("text")).alias("_words"), word_hashes(F.when(F.col("_extra") == 0, F.col("edited"))).alias("_edited_words"))
    rows = rows.withColumn("sketch", sketch_of(F.col("_words"), k)).withColumn("edited_sketch", sketch_of(F.col("_edited_words"), k))
    rows = rows.withColumn("next_sketch", F.lead("sketch").over(near)).where("_extra = 0")
    return rows.select(
        id_col, "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "sketch", "edited_sketch",
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"), resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
    )


def digests(pairs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return pairs.select(id_col, "n_chars", "edited_sha256", as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next")
