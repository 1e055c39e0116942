"""Operator 12, shards by a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns many points of a ring of 64-bit numbers; a document's key hashes to a place and belongs to the next point
clockwise. A shard takes at most its capacity: of what comes to it, rows in an order of their own (a second hash of the key)
until it is full; the others continue clockwise to the next point whose shard has room. Every round leaves every row
placed or one more shard full, so there are no more rounds than shards.

Defined results: a null or empty text has no bytes and crc 0; a row without a key is keyed by its text; equal rows come to
the same place and continue clockwise like others when its shard is full; other columns pass through, those named like the
results are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, prefix_sums, release, ship, texts_of

ship(__name__)

MADE = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def ring(shards: int, points: int):
    """The ring's places in order, and the shard of each. A shard's points depend on its number alone, so further shards leave them where they are."""
    import numpy as np

    at = [(int.from_bytes(hashlib.blake2b(b"%d:%d" % (s, i), digest_size=8).digest(), "big", signed=True), s) for s in range(shards) for i in range(points)]
    return tuple(np.array(x) for x in zip(*sorted(at), strict=True))


def serving(owner, is_open: list[bool]) -> list[int]:
    """For each point of the ring the shard of the first point from there clockwise that has room."""
    out, last = [0] * len(owner), None
    for i in [*range(len(owner) - 1, -1, -1)] * 2:
        if is_open[owner[i]]:
            last = int(owner[i])
        out[i] = last
    return out


def capacities(law: str, total: int, shards: int, slack: float) -> list[int]:
    """rows: counts at most one apart, all full in the end. bytes: (1 + slack) times an even share; a shard is full once it holds as much."""
    if law == "rows":
        return [total // shards + (s < total % shards) for s in range(shards)]
    return [max(1, -(-int(total * (1 + slack)) // shards))] * shards


def assign(docs: DataFrame, shards: int = 24, law: str = "rows", points: int = 512, slack: float = 0.01, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without text, with size (UTF-8 bytes and 8), text_crc32, law, shard, slot (from 0 in each shard) and grown_shard (null: a shard's rows depend on all).

    The ring is a table of shards * points rows, broadcast. Loads of shards (one number each) come to the driver after a round.
    """
    if law not in ("rows", "bytes"):
        raise ValueError(f"law is {law}, not rows or bytes")
    spark = docs.sparkSession
    places, owner = ring(shards, points)

    @F.pandas_udf("int")
    def point(place):
        import numpy as np
        import pandas as pd

        return pd.Series(np.searchsorted(places, place.to_numpy()) % len(places), dtype="int32")

    body = texts_of(docs, text)
    rest = [c for c in docs.columns if c not in (*MADE, text)]
    own = F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.concat(F.lit("t"), F.sha2(body, 256)))
    rows = docs.select(
        *rest,
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        F.xxhash64(own, F.lit("place")).alias("__place"),
        F.xxhash64(own, F.lit("turn")).alias("__turn"),
    )
    rows = rows.withColumns({"__point": point("__place"), "__row": F.monotonically_increasing_id(), "__one": F.lit(1).cast("long")}).drop("__place")
    pending = materialize(rows, "ring-rows")
    load = "__one" if law == "rows" else "size"
    total = pending.agg(F.coalesce(F.sum(load), F.lit(0))).head()[0]
    room, held, full = capacities(law, total, shards, slack), [0] * shards, [False] * shards
    order = ["shard", "__turn", "size", "text_crc32", "__row"]
    placed: list[DataFrame] = []
    while True:
        to = spark.createDataFrame(list(enumerate(serving(owner, [not x for x in full]))), "__point int, shard int")
        offered = pending.join(F.broadcast(to), "__point")
        ranked = prefix_sums(offered, order, {"__load": load, "__rank": "__one"}, "ring-round")
        ranked = materialize(ranked, "ring-ranked")
        came = {r[0]: r[1:] for r in ranked.groupBy("shard").agg(F.min("__load"), F.min("__rank"), F.sum(load)).collect()}
        state = [(s, low, rank, room[s], held[s]) for s, (low, rank, _) in came.items()]
        state = spark.createDataFrame(state, "shard int, __low long, __first long, __room long, __held long")
        judged = ranked.join(F.broadcast(state), "shard").withColumn("__fits", F.col("__load") - F.col("__low") < F.col("__room"))
        slot = F.col("__held") + F.col("__rank") - F.col("__first")
        done = judged.where("__fits").select(*rest, "size", "text_crc32", F.lit(law).alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
        placed.append(done)
        over = [s for s, (_, _, load_came) in came.items() if load_came > room[s]]
        if not over:
            break
        taken = {r[0]: r[1:] for r in judged.where("__fits").groupBy("shard").agg(F.sum(load), F.count("*")).collect()}
        for s, (weight, n) in taken.items():
            room[s] -= weight
            held[s] += n
            full[s] = room[s] <= 0
        following = judged.where("not __fits").select(*rest, "size", "text_crc32", "__turn", "__point", "__row", "__one")
        following = materialize(following, "ring-rows")
        release(pending)
        pending = following
    out = placed[0]
    for x in placed[1:]:
        out = out.unionByName(x)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: every document's place among 24 shards whose counts are at most one apart."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return assign(docs).select("doc_id", *MADE)
