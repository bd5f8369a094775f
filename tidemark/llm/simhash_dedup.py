"""SimHash near-duplicates with BK-trees.

Fingerprints are made in one pass over the texts; everything after works on distinct fingerprints alone, so a group of
exact copies is one row however large. Two fingerprints within the radius agree on all but `radius` of b equal blocks of
their bits, so for every choice of the agreeing blocks a table deals fingerprints to shards by these bits: any two that
link meet in one shard at least; no choice of b loses links. A shard is searched by a BK-tree (children keyed by integer
Hamming distance to the parent), following only edges within the radius, and leaves one link for each member that
another member is joined to, so dense groups leave as many rows as members, not as pairs. A shard over `HOT_SHARD` members is
searched in pairs of blocks of its members, so no task gathers more. Links of all shards meet in distributed rounds of
large-star and small-star, each round a written table.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bk_forest import Forest, unite
from tidemark.llm.shared import arrow_schema, map_rows, shards, small_batches, types_of
from tidemark.operators.components import connected
from tidemark.plans.scratch import scope, written

BITS, SEED = 64, 42
#: Mean members of a shard, above which more blocks are cut; members of a shard that one task may search.
SHARD_AIM, HOT_SHARD = 1024, 8192


def fingerprint(text: str | None, words: int) -> int:
    """Unsigned 64 bits: XXH64 (seed 42) of each shingle; a bit is set if over half of the hashes have it."""
    import xxhash

    own = text.encode("utf-8").lower().split() if text else []
    if not own:
        return 0
    k = min(words, len(own))
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), map(b" ".join, zip(*(own[i:] for i in range(k)), strict=False))), "<u8", len(own) - k + 1)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """id, fp (signed 64 bits) for each row; null and empty texts have 0, null ids and repeated rows are rows. bytes.lower() changes A-Z only, and bytes.split()
    parts at ASCII white space only."""

    def batch(b: pa.RecordBatch):
        return {id_col: b.column(0), "fp": np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)}

    return map_rows(docs.select(id_col, text_col), {id_col: types_of(docs)[id_col], "fp": "long"}, lambda: batch)


def block_masks(n: int, radius: int) -> list[int]:
    """For each choice of blocks that must agree, a mask of as many of their bits as make shards of about SHARD_AIM members, as
    signed 64-bit integers. Fingerprints within the radius agree in all bits of some choice, so in those of its mask."""
    wanted = max(0, (max(n, 1) - 1) // SHARD_AIM).bit_length()
    if not wanted:
        return [0]
    b = next((b for b in range(radius + 1, 16) if wanted <= BITS * (b - radius) // b), 16)
    edges = [BITS * i // b for i in range(b + 1)]
    blocks = [range(lo, hi) for lo, hi in zip(edges, edges[1:], strict=False)]
    assert comb(b, radius) < 4096
    masks = []
    for chosen in combinations(blocks, b - radius):
        bits = [i for block in chosen for i in block]
        k = min(wanted, len(bits))
        masks.append(sum(1 << bits[len(bits) * i // k] for i in range(k)))
    return [x - (1 << 64) if x >> 63 else x for x in masks]


def in_blocks(dealt: DataFrame, keys: list[str], item: str, most: int) -> DataFrame:
    """dealt with columns lo, hi after its keys: every pair of items of a shard meets under one (keys, lo, hi) at least.

    A shard of up to `most` items stays whole (0, 0). A larger one is cut into blocks by the items' hash; each item goes to
    the pairs of blocks that its own block is in, so a pair of blocks has about 2 * most items at most.
    """
    names = [c for c in dealt.columns if c not in keys]
    large = dealt.groupBy(*keys).agg(F.ceil(F.count("*") / most).alias("cut")).where("cut > 1")
    large = written(large, "large")
    whole = [F.lit(0).alias("lo"), F.lit(0).alias("hi")]
    if large.isEmpty():
        return dealt.select(*keys, *whole, *names)
    own = dealt.join(large, keys, "left").withColumn("b", F.pmod(F.xxhash64(item), F.col("cut")))
    other = F.explode(F.when(F.col("cut").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("cut") - 1))).alias("o")
    block = F.coalesce("b", F.lit(0))
    return own.select(*keys, block.alias("b"), other, *names).select(*keys, F.least("b", "o").cast("int").alias("lo"), F.greatest("b", "o").cast("int").alias("hi"), *names)


def dealt_out(dealt: DataFrame, n_keys: int) -> DataFrame:
    keys = dealt.columns[:n_keys]
    return dealt.repartition(*keys).sortWithinPartitions(*keys)


def shard_links(distinct: DataFrame, radius: int, hot_shard: int = HOT_SHARD) -> DataFrame:
    """a, b: links of distinct fingerprints (column fp, no nulls) that join whatever chains of links join; no fingerprints, no links."""
    masks = block_masks(distinct.count(), radius)
    keys = F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])
    dealt = in_blocks(distinct.select("fp", F.explode(keys).alias("k")).select("k.t", "k.key", "fp"), ["t", "key"], "fp", hot_shard)

    def run(batches):
        schema = arrow_schema("a long, b long")

        def work(rows: pa.Table, starts: np.ndarray):
            fp = rows.column("fp").to_numpy()
            forest = Forest(fp.view(np.uint64), np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(fp)))))
            part = np.arange(len(fp))
            for asked, found, far in forest.searches(radius):
                part, _ = unite(part, asked, found, far)
            joined = np.flatnonzero(part != np.arange(len(fp)))
            return pa.RecordBatch.from_arrays([pa.array(fp[joined]), pa.array(fp[part[joined]])], schema=schema)

        return shards(batches, 4, work)

    return dealt_out(dealt, 4).mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text", hot_shard: int = HOT_SHARD) -> DataFrame:
    """id, fingerprint (16 hex digits), component_id (the smallest id that links reach, the own one included).

    A null or empty text has fingerprint zero and links like any other; texts of fewer words than a shingle are one
    shingle. Repeated rows each give a row; null ids are kept but never name a component (its id is null if all are
    null). An empty table gives no rows. Only the two named columns are read. Texts of any length are hashed whole.
    """
    small_batches(docs.sparkSession)
    with scope() as keep:
        own = keep(written(fingerprints(docs, words, id_col, text_col), "fingerprints"))
        distinct = written(own.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct")
        joined = connected(shard_links(distinct.select("fp"), radius, hot_shard)).toDF("node", "center")
        placed = distinct.join(joined, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("center", "fp").alias("center"))
        named = placed.groupBy("center").agg(F.min("least").alias("component_id"))
        by_fp = keep(written(placed.join(named, "center").select("fp", "component_id"), "named"))
    return own.join(by_fp, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
