"""Sharding by balanced label propagation, in DataFrame functions only.

Documents with equal texts are linked. Linked documents start in shards by a hash of their id. In
each round a document may move to the shard that holds most of its copies (more than its own shard
does), as long as that shard has room: arrivals beyond the quota wait, chosen by hash bucket and, in the
bucket in which the quota is reached, by an exact rank. A shard that takes what it can is full to the
row and then no target, so a group larger than a shard fills one after the other. Rows without
links cut nothing wherever they lie and come last, to fill every shard to its exact quota; linked rows
beyond a quota, if any, are dealt with them. The law is `rows`: counts are at most one apart.

Only per-shard counts and per-shard-and-bucket counts (at most shards x BUCKETS rows) come to the
driver. A group is a few rows of counts, never collected; copies meet their counts in a join that
feeds no grouping, which Spark may split where it is skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import cut
from spanloom.llm.ranking import exact_rank, place

SHARDS, ROUNDS, BUCKETS = 16, 10, 256


def shard_documents(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, size, text_crc32, law, shard, slot, grown_shard) for each row.

    size: UTF-8 bytes of the text (null: none) plus 1. Null texts are linked with each other like
    equal texts, and their crc32 is that of no bytes. Rows may repeat and null ids are allowed: every
    row gets a slot of its own. With fewer rows than shards some shards stay empty. Other columns are
    not read.
    """
    text = docs[text_col].cast("string")
    base = docs.select(
        docs[id_col].alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"), F.coalesce(F.unhex(F.md5(text)), F.unhex(F.lit("00"))).alias("text"),
    )
    base = cut(base.withColumn("row", F.monotonically_increasing_id()))
    total = base.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]

    copies = base.groupBy("text").agg(F.count("*").alias("copies"))
    start = F.pmod(F.xxhash64("id", "row"), F.lit(shards)).cast("int")
    marked = cut(base.join(copies, "text").withColumn("shard", F.when(F.col("copies") > 1, start)).drop("copies"))
    state, alone = marked.where("shard is not null"), marked.where("shard is null")

    for turn in range(rounds):
        load = [0] * shards
        for r in state.groupBy("shard").agg(F.count("*").alias("n")).collect():
            load[r["shard"]] = r["n"]
        room = [q - n for q, n in zip(quota, load, strict=True)]
        if sum(load) == 0 or not any(x > 0 for x in room):
            break
        counts = state.groupBy("text", "shard").agg(F.count("*").alias("n")).withColumn("pull", F.struct("n", F.xxhash64("text", "shard").alias("tie"), "shard"))
        open_shards = [s for s in range(shards) if room[s] > 0]
        best = counts.where(F.col("shard").isin(open_shards)).groupBy("text").agg(F.max("pull").alias("best"))
        moves = counts.join(best, "text").where("best > pull").select("text", "shard", F.col("best.shard").alias("target"))
        moving = state.join(moves, ["text", "shard"], "left").withColumn("bucket", F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(BUCKETS)).cast("int"))
        moving = cut(moving)
        wish: dict[int, dict[int, int]] = {s: {} for s in range(shards)}
        for r in moving.where("target is not null").groupBy("target", "bucket").agg(F.count("*").alias("n")).collect():
            wish[r["target"]][r["bucket"]] = r["n"]
        limit, part, accepted, split = [], [], 0, 0
        for s in range(shards):  # buckets below the limit come in, and of the one at the limit as many rows as have room left
            at, left = 0, room[s]
            while at < BUCKETS and wish[s].get(at, 0) <= left:
                left -= wish[s].get(at, 0)
                accepted += wish[s].get(at, 0)
                at += 1
            limit.append(at)
            part.append(left if at < BUCKETS else 0)
            accepted += part[s]
            split += wish[s].get(at, 0) if part[s] else 0
        if not accepted:
            break
        of = lambda counts: F.get(F.array(*map(F.lit, counts)), F.col("target"))
        at_limit = F.coalesce((F.col("bucket") == of(limit)) & (of(part) > 0), F.lit(False))
        state = moving.where(~at_limit).withColumn("shard", F.when(F.col("bucket") < of(limit), F.col("target")).otherwise(F.col("shard")))
        if split:
            ranked = exact_rank(moving.where(at_limit), "target", ["row"], split, "rank", shards)
            state = state.unionByName(ranked.withColumn("shard", F.when(F.col("rank") < of(part), F.col("target")).otherwise(F.col("shard"))).drop("rank"))
        state = state.drop("target", "bucket")

    ranked = cut(exact_rank(state, "shard", ["text", "row"], total, "slot", shards))
    full = F.get(F.array(*map(F.lit, quota)), F.col("shard"))
    settled = [0] * shards
    for r in ranked.where(F.col("slot") < full).groupBy("shard").agg(F.count("*").alias("n")).collect():
        settled[r["shard"]] = r["n"]
    need = [q - n for q, n in zip(quota, settled, strict=True)]
    columns = ["id", "size", "text_crc32", "shard", "slot"]
    rest = alone.select("id", "size", "text_crc32", "row").unionByName(ranked.where(F.col("slot") >= full).select("id", "size", "text_crc32", "row"))
    rest = exact_rank(rest.withColumn("all", F.lit(0)), "all", ["row"], total, "rank", 1)
    shard, offset = place(F.col("rank"), need)
    rest = rest.withColumn("shard", shard).withColumn("slot", offset + F.get(F.array(*(F.lit(n).cast("long") for n in settled)), F.col("shard")))
    out = ranked.where(F.col("slot") < full).select(columns).unionByName(rest.select(columns))
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
