"""Near-duplicate groups by similarity: SimHash with BK-trees proposes, whole shingle sets decide, a prefix filter completes.

A similarity of 0.8 is about 10 of 64 SimHash bits, too many for blocks of agreeing bits. So there are two steps, over distinct sets
of shingles (equal sets are one node from the start, however many texts have them):

1. Shards are dealt by min-hash keys and searched by BK-trees over 256-bit fingerprints; each shard proposes every member's nearest
   one and a spanning forest of what lies within the radius, as many pairs as members. Whole sets decide on each pair. This
   joins nearly all that belongs together.
2. The exact completion: in one order of all shingles, common ones last, two sets at the similarity share one of their first
   n - ceil(similarity * n) + 1 shingles. Wherever members of different groups share such a shingle, pairs of different groups
   whose sizes and fingerprints allow the similarity are compared by whole sets, in pairs of blocks of bounded
   size. Fingerprints exclude in two ways: by 384 parities of the shingles, which differ in no more bits than the sets differ in
   shingles, so that they never exclude a link; and, where both sets have FEW shingles or more, by SimHash: sets at the similarity differ
   in some 40 of 256 bits (deviation 6), and only pairs over EXACT_RADIUS bits apart are passed over, a chance under 1e-14 for a link.
"""

from __future__ import annotations

from itertools import chain
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bk_forest import Forest, hamming, unite
from tidemark.llm.shared import arrow_schema, free_name, lists, map_rows, shards, small_batches, text_keys, types_of, word_hashes
from tidemark.llm.simhash_dedup import dealt_out, in_blocks
from tidemark.operators.components import connected
from tidemark.plans.scratch import drop, scope, written

#: Fingerprint words of 64 bits, min-hash keys and minima in each key, and the radius in bits within which step 1 proposes.
WIDE, KEYS, MINIMA, WIDE_RADIUS = 4, 6, 2, 80
#: Parity bits of a set, after its SimHash words in the column bits.
PARITIES = 384
#: Radius in bits within which step 2 compares whole sets, and the size from which it does. Of two sets of FEW shingles or more at a similarity of
#: 0.8, a bit differs with a chance of 0.16 at most, so 97 of the 256 differ with one under 1e-14. Smaller sets are compared whatever their bits are.
EXACT_RADIUS, FEW = 96, 64
#: Members of a shard that one task searches in step 1, and half of those that one task compares by whole sets in step 2.
SEARCHED, COMPARED = 4096, 512
#: Pairs for each member of a shard that are compared one by one; the members of a shard with more are compared together.
PAIRS_A_MEMBER = 4
#: Of each set's shards, the first that are known wherever the set is: a pair that meets in one of these is compared there alone.
FIRSTS = 8
#: Shingles known to be common, which come last in the order of step 2; any number gives the same groups.
MAX_COMMON = 100_000
#: Rows of three numbers that may be broadcast; above, the join shuffles.
MAX_BROADCAST_ROWS = 500_000


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x ^ np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `words` words, A-Z lowered; a shorter text is one run."""
    h = word_hashes(text.encode("utf-8").lower()) if text else np.empty(0, np.uint64)
    if not len(h):
        return h
    k = min(words, len(h))
    n = len(h) - k + 1
    x = h[:n].copy()
    for i in range(1, k):
        x *= np.uint64(0x9E3779B97F4A7C15)
        x += h[i : i + n]
    return np.unique(_mixed(x, k))


def set_key(shingles: np.ndarray) -> int:
    """A signed 64-bit hash of a set; 0 for the empty one."""
    return int(np.bitwise_xor.reduce(_mixed(shingles, 99)).view(np.int64)) if len(shingles) else 0


def fingerprint(shingles: np.ndarray) -> bytes:
    """SimHash of WIDE words, then PARITIES bits: is the number of shingles that fall on the bit odd?"""
    ones, parity = np.zeros(64 * WIDE, np.int64), np.zeros(PARITIES, np.int64)
    for at in range(0, len(shingles), 1 << 15):
        own = shingles[at : at + (1 << 15)]
        wide = np.stack([_mixed(own, i + 1) for i in range(WIDE)], axis=1)
        ones += np.unpackbits(wide.view(np.uint8).reshape(len(own), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
        parity += np.bincount((own % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES)
    return np.packbits(np.concatenate([2 * ones > len(shingles), parity % 2 == 1]), bitorder="little").tobytes()


def min_hash_keys(sets: list[np.ndarray]) -> np.ndarray:
    """KEYS signed 64-bit keys for each of the sets, none of them empty."""
    size = np.array([len(s) for s in sets])
    all_, starts = np.concatenate([np.empty(0, np.uint64), *sets]), np.cumsum(size) - size
    keys = np.repeat(np.arange(KEYS, dtype=np.uint64)[None], len(sets), axis=0)
    for i in range(KEYS if len(sets) else 0):
        for j in range(MINIMA):
            keys[:, i] ^= _mixed(np.minimum.reduceat(_mixed(all_, 50 + i * MINIMA + j), starts), 7 + j)
    return keys.view(np.int64)


def common_shingles(sets: dict[int, np.ndarray], least: int = 3) -> tuple[list[int], list[int]]:
    """(shingle, number of sets) of those in at least `least` of a batch's distinct sets."""
    all_ = np.concatenate([np.empty(0, np.uint64), *sets.values()])
    found, n = np.unique(all_, return_counts=True)
    return found[n >= least].view(np.int64).tolist(), n[n >= least].tolist()


def prefix(shingles: np.ndarray, similarity: float, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first n - ceil(similarity * n) + 1 shingles, rare ones first; common is sorted and has a rank of 1 or more each."""
    keep = len(shingles) - ceil(similarity * len(shingles) - 1e-9) + 1
    if len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        own = np.where(common[at] == shingles, rank[at], 0)
        shingles = shingles[np.lexsort((shingles, own))]
    return shingles[:keep]


def proposals(values: np.ndarray, starts: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions within the radius: each member's nearest, and a spanning forest of each shard's links; none of no values or lone ones."""
    forest = Forest(values, np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(values)))))
    part, out = np.arange(len(values)), []
    for asked, found, far in forest.searches(radius):
        own = asked != found
        asked, found, far = asked[own], found[own], far[own]
        part, chosen = unite(part, asked, found, far)
        order = np.lexsort((far, asked))
        nearest = order[np.diff(asked[order], prepend=-1) != 0]
        some = np.union1d(chosen, nearest)
        out.append((asked[some], found[some]))
    return tuple(np.concatenate([np.empty(0, np.int64), *x]).astype(np.int64) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 2


def met_before(key: np.ndarray, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Do the rows of one and other have a number below key in common?"""
    out = np.zeros(len(key), bool)
    for at in range(0, len(key), 1 << 14):
        own = slice(at, at + (1 << 14))
        out[own] = ((one[own, :, None] == other[own, None, :]) & (one[own, :, None] < key[own, None, None])).any(axis=(1, 2))
    return out


def neighbours(shard: np.ndarray):
    """Yields (a, b), a < b: all pairs of positions of one shard; shards lie together."""
    ends = np.searchsorted(shard, shard, "right")
    at, step = np.arange(len(shard)), 1
    while len(at := at[at + step < ends[at]]):
        yield at, at + step
        step += 1


def crossing(values: np.ndarray, parity: np.ndarray, starts: np.ndarray, key: np.ndarray, firsts: np.ndarray, center: np.ndarray, size: np.ndarray, similarity: float, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(members, a, b): pairs of different groups in a shard that could link, as pairs where a shard has few, else as members.

    A pair that shares a shard before this one, as far as their first ones tell, is left to that.
    """
    n = np.diff(np.append(starts, len(values)))
    shard = np.repeat(np.arange(len(starts)), n)
    pairs = [np.empty((0, 2), np.int64)]
    # sets of fewer than FEW shingles, with all that they could link to; then larger ones, by their trees
    small, large = np.flatnonzero(size < FEW / similarity), np.flatnonzero(size >= FEW)
    forest = Forest(values[large], np.unique(shard[large], return_inverse=True)[1]) if len(large) else None
    ways = ((small[x], small[y], True) for x, y in neighbours(shard[small])), ((large[x], large[y], False) for x, y, _ in (forest.searches(radius) if forest else ()))
    for asked, found, few in chain(*ways):
        open_ = (asked < found) & (center[asked] != center[found])
        if few:
            open_ &= np.minimum(size[asked], size[found]) < FEW
        open_ &= np.minimum(size[asked], size[found]) >= similarity * np.maximum(size[asked], size[found]) - 1e-9
        asked, found = asked[open_], found[open_]
        # at the similarity, sets differ in this many shingles at most, and their parities in no more bits
        open_ = hamming(parity[asked], parity[found]) <= (size[asked] + size[found]) * ((1 - similarity) / (1 + similarity)) + 1e-9
        asked, found = asked[open_], found[open_]
        open_ = ~met_before(key[asked], firsts[asked], firsts[found])
        pairs.append(np.stack([asked[open_], found[open_]], axis=1))
    all_ = np.concatenate(pairs)
    many = np.bincount(shard[all_[:, 0]], minlength=len(starts)) > PAIRS_A_MEMBER * n
    dense = many[shard[all_[:, 0]]]
    return np.unique(all_[dense]), all_[~dense, 0], all_[~dense, 1]


def links_between(centers: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Pairs of positions that join whatever parts a pair of sets at `similarity` or more joins; all sets have members."""
    part = np.unique(centers, return_inverse=True)[1]
    sizes = np.array([len(x) for x in sets])
    ids = np.split(np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32), np.cumsum(sizes)[:-1])
    mark, out = np.zeros(sum(map(len, sets)), bool), []
    for i in range(len(sets)):
        others = i + 1 + np.flatnonzero(part[i + 1 :] != part[i])
        others = others[np.minimum(sizes[others], sizes[i]) >= similarity * np.maximum(sizes[others], sizes[i]) - 1e-9]
        mark[ids[i]] = True
        for at in range(0, len(others), 256):
            own = others[at : at + 256]
            own = own[part[own] != part[i]]
            if not len(own):
                continue
            shared = np.add.reduceat(mark[np.concatenate([ids[x] for x in own])], np.append(0, np.cumsum(sizes[own])[:-1]), dtype=np.int64)
            for x in own[shared >= similarity * (sizes[own] + sizes[i] - shared)]:
                if part[x] != part[i]:
                    out.append((i, int(x)))
                    part[part == part[x]] = part[i]
        mark[ids[i]] = False
    return out


def _limited(rows: DataFrame) -> DataFrame:
    return F.broadcast(rows) if rows.count() <= MAX_BROADCAST_ROWS else rows


def _bits(rows: pa.Table) -> np.ndarray:
    """SimHash words, then parity words, of each row."""
    return np.frombuffer(b"".join(rows.column("bits").to_pylist()), "<u8").reshape(len(rows), WIDE + PARITIES // 64)


def _sketches(rows: DataFrame, words: int) -> DataFrame:
    """id, h, g, node, keys, bits; and, on one row of each batch, the batch's common shingles."""

    def batch(b: pa.RecordBatch):
        own = [shingle_set(t, words) for t in b.column(3).to_pylist()]
        nodes = [set_key(s) for s in own]
        sets = {n: s for n, s in zip(nodes, own, strict=True) if len(s)}
        keys = dict(zip(sets, min_hash_keys(list(sets.values())).tolist(), strict=True))
        bits = {n: fingerprint(s) for n, s in sets.items()}
        out = {"node": nodes, "keys": [keys.get(n, []) for n in nodes], "bits": [bits.get(n, b"") for n in nodes]}
        rest = [None] * (len(b) - 1)
        common, times = common_shingles(sets)
        return out | {c: b.column(i) for i, c in enumerate(("id", "h", "g"))} | {"common": [common, *rest], "times": [times, *rest]}

    kind = types_of(rows)["id"]
    columns = {"id": kind, "h": "long", "g": "long", "node": "long", "keys": "array<long>", "bits": "binary", "common": "array<long>", "times": "array<long>"}
    return map_rows(rows, columns, lambda: batch)


def _sets(rows: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """node, shingles of the nodes (column node of nodes, which has their row's id, h and g); each text is read by one row."""
    asked = nodes.select("node", F.col("least.id").alias("_id"), F.col("least.h").alias("_h"), F.col("least.g").alias("_g"))
    texts = rows.join(_limited(asked), (F.col("h") == F.col("_h")) & (F.col("g") == F.col("_g")) & F.col("id").eqNullSafe(F.col("_id"))).select("node", "text")

    def batch(b: pa.RecordBatch):
        return {"node": b.column(0), "shingles": lists([shingle_set(t, words) for t in b.column(1).to_pylist()])}

    return map_rows(texts, {"node": "long", "shingles": "array<long>"}, lambda: batch).dropDuplicates(["node"])


def _proposed(nodes: DataFrame, searched: int) -> DataFrame:
    """a > b: the pairs of step 1."""
    dealt = nodes.where("node != 0").select(F.explode("keys").alias("key"), "node", "bits")
    # a shard that is too large is cut by a hash of member and key: other keys cut it otherwise, and step 2 completes
    large = written(dealt.groupBy("key").agg(F.ceil(F.count("*") / searched).cast("int").alias("cut")).where("cut > 1"), "large")
    salt = F.lit(0).alias("salt")
    if not large.isEmpty():
        dealt, salt = dealt.join(large, "key", "left"), F.coalesce(F.pmod(F.xxhash64("node", "key"), F.col("cut")), F.lit(0)).cast("int").alias("salt")

    def run(batches):
        schema = arrow_schema("a long, b long")

        def work(rows: pa.Table, starts: np.ndarray):
            node = rows.column("node").to_numpy()
            x, y = proposals(_bits(rows)[:, :WIDE], starts, WIDE_RADIUS)
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(node[x], node[y])), pa.array(np.minimum(node[x], node[y]))], schema=schema)

        return shards(batches, 2, work)

    return dealt_out(dealt.select("key", salt, "node", "bits"), 2).mapInArrow(run, "a long, b long").distinct()


def _prefixes(rows: DataFrame, own: DataFrame, words: int, similarity: float) -> DataFrame:
    """node, size, prefix, for the rows' texts with words; equal nodes may come more than once."""
    counted = own.where("common is not null").select(F.explode(F.arrays_zip("common", "times")).alias("c")).groupBy("c.common").agg(F.sum("c.times").alias("n"))
    top = counted.orderBy(F.desc("n"), "common").limit(MAX_COMMON).toArrow()  # an order only: bounded, and right at any bound
    common = top.column("common").to_numpy().view(np.uint64)
    order = np.argsort(common)
    shared = rows.sparkSession.sparkContext.broadcast((common[order], (len(common) - np.arange(len(common)))[order]))

    def build():
        common, rank = shared.value

        def batch(b: pa.RecordBatch):
            sets = [s for s in (shingle_set(t, words) for t in b.column(0).to_pylist()) if len(s)]
            return {"node": [set_key(s) for s in sets], "size": [len(s) for s in sets], "prefix": lists([prefix(s, similarity, common, rank) for s in sets])}

        return batch

    return map_rows(rows.select("text"), {"node": "long", "size": "int", "prefix": "array<long>"}, build)


def _lost_links(rows: DataFrame, own: DataFrame, parts: DataFrame, words: int, similarity: float, compared: int) -> DataFrame | None:
    """a, b: links between different groups (column center), by step 2; None if no two groups share a shingle of their prefixes."""
    made = written(_prefixes(rows, own, words, similarity), "prefixes")
    found = made.groupBy("node").agg(F.first("size").alias("size"), F.first("prefix").alias("prefix")).join(parts.select("node", "center", "bits"), "node")
    found = written(found, "members")
    drop(made)
    postings = found.select(F.explode("prefix").alias("key"), "node", "center")
    mixed = postings.groupBy("key").agg(F.min("center").alias("lo"), F.max("center").alias("hi")).where("lo != hi").select("key")
    mixed = written(postings.join(written(mixed, "mixed"), "key"), "mixed")
    # keys that the same nodes share are one
    alike = mixed.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("s")).groupBy("n", "s").agg(F.min("key").alias("key"))
    chosen = written(mixed.join(alike.select("key"), "key"), "chosen")
    firsts = chosen.groupBy("node").agg(F.slice(F.sort_array(F.collect_list("key")), 1, FIRSTS).alias("firsts"))
    dealt = chosen.join(found.select("node", "size", "bits").join(firsts, "node"), "node").select("key", "node", "center", "size", "bits", "firsts")
    dealt = dealt_out(in_blocks(dealt, ["key"], "node", compared), 3)
    kinds = "key long, lo int, hi int, node long, center long, other long"

    def find(batches):
        schema = arrow_schema(kinds)

        def work(rows: pa.Table, starts: np.ndarray):
            col = {c: rows.column(c).to_numpy() for c in ("key", "lo", "hi", "node", "center", "size")}
            bits = _bits(rows)
            flat = rows.column("firsts").combine_chunks()
            flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
            n = flat.value_lengths().to_numpy()
            firsts = np.full((len(rows), FIRSTS), np.iinfo(np.int64).max)
            firsts[np.arange(FIRSTS) < n[:, None]] = flat.flatten().to_numpy()
            at, x, y = crossing(bits[:, :WIDE], bits[:, WIDE:], starts, col["key"], firsts, col["center"], col["size"], similarity, EXACT_RADIUS)
            pairs = np.unique(np.sort(np.stack([col["node"][x], col["node"][y]], axis=1), axis=1), axis=0)
            none = np.zeros(len(pairs), np.int64)
            made = {c: np.concatenate([col[c][at], none]) for c in ("key", "lo", "hi", "center")} | {"node": np.concatenate([col["node"][at], pairs[:, 1]])}
            other = pa.array(np.concatenate([np.zeros(len(at), np.int64), pairs[:, 0]]), mask=np.arange(len(at) + len(pairs)) < len(at))
            return pa.RecordBatch.from_arrays([other if f.name == "other" else pa.array(made[f.name].astype(f.type.to_pandas_dtype())) for f in schema], schema=schema)

        return shards(batches, 3, work)

    asked = written(dealt.mapInArrow(find, kinds), "crossings")
    if asked.isEmpty():
        return None
    pairs = written(asked.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")).distinct(), "pairs")
    nodes = written(asked.select("node").union(pairs.select("b")).distinct().join(parts.select("node", "least"), "node"), "asked")
    whole = written(_sets(rows, nodes, words), "sets")

    def check(batches):
        schema = arrow_schema("a long, b long")

        def work(rows: pa.Table, starts: np.ndarray):
            node, center = (rows.column(c).to_numpy() for c in ("node", "center"))
            flat = rows.column("shingles").combine_chunks()
            flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
            sets = np.split(flat.flatten().to_numpy(), np.cumsum(flat.value_lengths().to_numpy())[:-1])
            out = [(lo + x, lo + y) for lo, hi in zip(starts, [*starts[1:], len(node)], strict=True) if hi - lo > 1 for x, y in links_between(center[lo:hi], sets[lo:hi], similarity)]
            x, y = (np.array([p[i] for p in out], np.int64) for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(node[x]), pa.array(node[y])], schema=schema)

        return shards(batches, 3, work)

    dense = dealt_out(asked.where("other is null").join(whole, "node").select("key", "lo", "hi", "node", "center", "shingles"), 3)
    return written(dense.mapInArrow(check, "a long, b long").union(_linked(pairs, whole, similarity)).distinct(), "more")


def _linked(pairs: DataFrame, whole: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sets reach the similarity."""
    side = lambda n, c: whole.select(F.col("node").alias(n), F.col("shingles").alias(c))
    shared = F.size(F.array_intersect("x", "y"))
    return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").where(shared >= F.lit(similarity) * (F.size("x") + F.size("y") - shared)).select("a", "b")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    h, g = text_keys(text_col)
    return docs.select(F.col(id_col).alias("id"), h.alias("h"), g.alias("g"), F.col(text_col).alias("text"))


def _grouped(docs: DataFrame, words: int, similarity: float, id_col: str, text_col: str, searched: int, compared: int) -> tuple[DataFrame, DataFrame]:
    """(id, h, g, node of each row; node and first, the struct (no, id, h, g) of its group's row of the smallest id)."""
    small_batches(docs.sparkSession)
    rows = _rows(docs, id_col, text_col)
    with scope() as keep:
        own = keep(written(_sketches(rows, words), "sketches"))
        least = F.min(F.struct(F.col("id").isNull().alias("no"), "id", "h", "g")).alias("least")
        nodes = written(own.groupBy("node").agg(least, F.first("keys").alias("keys"), F.first("bits").alias("bits")), "nodes")
        joined = _proposed_groups(rows, nodes, words, similarity, searched)
        parts = written(nodes.join(joined, "node", "left").select("node", "least", "bits", F.coalesce("center", "node").alias("center")), "parts")
        with scope() as keep_links:
            more = _lost_links(rows, own, parts, words, similarity, compared)
            if more is not None:
                keep_links(more)
        if more is not None and not more.isEmpty():
            joined = connected(joined.select(F.col("node").alias("a"), F.col("center").alias("b")).union(more)).toDF("node", "center")
            parts = nodes.join(joined, "node", "left").select("node", "least", F.coalesce("center", "node").alias("center"))
        first = parts.groupBy("center").agg(F.min("least").alias("first"))
        named = keep(written(parts.select("node", "center").join(first, "center").select("node", "first"), "named"))
    return own.select("id", "h", "g", "node"), named


def _proposed_groups(rows: DataFrame, nodes: DataFrame, words: int, similarity: float, searched: int) -> DataFrame:
    """node, center: the groups that step 1 finds."""
    pairs = written(_proposed(nodes, searched), "pairs")
    asked = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "least"), "node"), "asked")
    whole = written(_sets(rows, asked, words), "sets")
    joined = connected(_linked(pairs, whole, similarity)).toDF("node", "center")
    drop(whole)
    return joined


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", searched: int = SEARCHED, compared: int = COMPARED) -> DataFrame:
    """id, component_id: groups of texts joined by chains of shingle sets with a Jaccard similarity of at least `similarity`.

    Texts without words (null, empty, blank) form one group. Rows without id are grouped like any other but never name a
    group (its id is null if all are null); repeated rows give a row each; an empty table gives none. Only the two
    named columns are read; texts of any length are compared whole.
    """
    own, named = _grouped(docs, words, similarity, id_col, text_col, searched, compared)
    return own.join(named, "node").select(F.col("id").alias(id_col), F.col("first.id").alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of `similar_groups`: that of the smallest id (of the smallest text hash, if an id has
    several texts in the group; rows without id give way to any with one).

    An id whose texts are of several groups stays in each group where it is the smallest. Repeated rows of the kept id and text are one row.
    The columns are those of docs; an empty table gives none.
    """
    same = F.col("first.id").eqNullSafe(F.col("id")) & (F.col("first.h") == F.col("h")) & (F.col("first.g") == F.col("g"))
    with scope() as keep:
        own, named = _grouped(docs, words, similarity, id_col, text_col, SEARCHED, COMPARED)
        told = keep(written(own.join(named, "node").groupBy("id", "h", "g").agg(F.first(same).alias("stays"), F.count("*").alias("n")), "told"))
    names = dict(zip(("id", "h", "g"), (free_name(f"_{c}", docs.columns) for c in ("id", "h", "g")), strict=True))
    h, g = text_keys(text_col)
    keyed = docs.withColumns({names["h"]: h, names["g"]: g, names["id"]: F.col(id_col)})

    def join(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        other = _limited(right.select(*[F.col(c).alias(f"{x}_") for c, x in names.items()]))
        return left.join(other, (F.col(names["h"]) == F.col(f"{names['h']}_")) & (F.col(names["g"]) == F.col(f"{names['g']}_")) & F.col(names["id"]).eqNullSafe(F.col(f"{names['id']}_")), how)

    left = join(keyed, told.where("not stays"), "left_anti")
    twice = told.where("stays and n > 1")
    if not twice.isEmpty():
        left = join(left, twice, "left_anti").unionByName(join(left, twice, "left_semi").dropDuplicates(list(names.values())))
    return left.select(*docs.columns)
