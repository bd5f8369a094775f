"""Token ids as raw binary shards under a minimal perfect hash index.

A store is a folder of shard files, each holding the ids of a range of documents in ascending order as unsigned little-endian integers
(2 bytes where the vocabulary allows it, else 4), a Parquet table of rows by document, and a Parquet table
of index buckets. A bucket holds some 50,000 keys: bit arrays of a minimal perfect hash by levels (a key takes the
first level where its bit is its own; its slot is the rank of that bit), and by slot a 32-bit fingerprint, the shard,
the place in it and the length. A look-up reads one bucket, a few bits, one slot and one range of one shard.
"""

from __future__ import annotations

import posixpath
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tidemark.llm.shared import arrow_schema, map_rows, small_batches
from tidemark.llm.word_tokens import word_tokens
from tidemark.plans.scratch import scratch_path

KEYS_PER_BUCKET = 50_000
LEVELS, LOAD = 48, 1.6
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A well-known 64-bit finalizer over seeded keys."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def key_hash(doc_id: np.ndarray, copy: np.ndarray) -> np.ndarray:
    """doc_id: signed 64-bit; copy: 0 for the first row of an id, then 1, 2 ...; -1 - n for the n-th row without id."""
    with np.errstate(over="ignore"):
        return mix(doc_id.astype(np.int64).view(np.uint64) ^ mix(copy.astype(np.int64).view(np.uint64), 7), 11)


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys, as bit arrays by level."""

    def __init__(self, sizes: list[int], bits: bytes):
        self.sizes, self.bits = sizes, np.frombuffer(bits, np.uint8)
        self.base = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        pop = np.bitwise_count(self.bits).astype(np.int64)
        self.rank = np.concatenate([[0], np.cumsum(pop)])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, levels, left = [], [], keys
        while len(left):
            if len(sizes) == LEVELS:
                raise ValueError("equal keys in one index bucket")
            m = max(64, int(len(left) * LOAD) // 8 * 8)
            at = (mix(left, 100 + len(sizes)) % np.uint64(m)).astype(np.int64)
            own = np.bincount(at, minlength=m) == 1
            sizes.append(m)
            levels.append(np.packbits(own, bitorder="little"))
            left = left[~own[at]]
        return cls(sizes, b"".join(x.tobytes() for x in levels))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot by key; -1 for some keys that were not among those built from (the fingerprint tells the others)."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, m in enumerate(self.sizes):
            if not len(open_):
                break
            at = self.base[level] + (mix(keys[open_], 100 + level) % np.uint64(m)).astype(np.int64)
            byte, bit = at >> 3, (at & 7).astype(np.uint8)
            hit = (self.bits[byte] >> bit) & 1 == 1
            below = self.bits[byte] & ((np.uint8(1) << bit) - np.uint8(1)).astype(np.uint8)
            out[open_[hit]] = (self.rank[byte] + np.bitwise_count(below))[hit]
            open_ = open_[~hit]
        return out


def _bucket(n: int):
    return F.pmod(F.xxhash64("doc_id", "copy"), F.lit(n)).cast("int")


INDEX = "bucket int, n_keys long, sizes array<long>, bits binary, fingerprints binary, shards binary, places binary, lengths binary"


def _build_bucket(table: pa.Table) -> pa.Table:
    col = {c: table.column(c).to_numpy() for c in ("doc_id", "copy", "shard", "place", "n_tokens")}
    keys = key_hash(col["doc_id"], col["copy"])
    found = PerfectHash.build(keys)
    by_slot = np.argsort(found.slots(keys))
    with_type = lambda c, t: col[c][by_slot].astype(t).tobytes()
    row = {"bucket": table.column("bucket")[0].as_py(), "n_keys": len(keys), "sizes": found.sizes, "bits": found.bits.tobytes(), "fingerprints": (mix(keys, 3)[by_slot] >> np.uint64(32)).astype("<u4").tobytes(), "shards": with_type("shard", "<u4"), "places": with_type("place", "<u8"), "lengths": with_type("n_tokens", "<u4")}
    return pa.Table.from_pylist([row], schema=arrow_schema(INDEX))


def locate(index: dict, doc_id: np.ndarray, copy: np.ndarray) -> tuple[np.ndarray, ...]:
    """(known, shard, place, length) of keys in one bucket of the index, in constant time each."""
    keys = key_hash(doc_id, copy)
    slots = PerfectHash(index["sizes"], index["bits"]).slots(keys)
    at = np.maximum(slots, 0)
    known = (slots >= 0) & (np.frombuffer(index["fingerprints"], "<u4")[at] == (mix(keys, 3) >> np.uint64(32)).astype(np.uint32))
    return known, *(np.frombuffer(index[c], t)[at].astype(np.int64) for c, t in (("shards", "<u4"), ("places", "<u8"), ("lengths", "<u4")))


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class TokenStore:
    """A written store: path, shard file names with the ids before each, bytes by id, number of index buckets."""

    def __init__(self, spark: SparkSession, path: str, files: list[str], starts: list[int], width: int, n_buckets: int):
        self.spark, self.path, self.files, self.starts, self.width, self.n_buckets = spark, path, files, starts, width, n_buckets

    def keys(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows").select("doc_id", "copy")

    def index(self) -> DataFrame:
        return self.spark.read.schema(INDEX).parquet(f"{self.path}/index")

    def get(self, doc_id: int, copy: int = 0) -> list[int] | None:
        """The ids of one document, or None."""
        one = self.spark.createDataFrame([(doc_id, copy)], "doc_id long, copy long")
        got = self.read(one, with_ids=True).collect()
        return np.frombuffer(got[0]["ids"], f"<u{self.width}").tolist() if got else None

    def read(self, keys: DataFrame, with_ids: bool = False) -> DataFrame:
        """doc_id, start, n_tokens, ids_crc32 (and the raw ids) of the keys that the store has, through the index."""
        width, files, path = self.width, self.files, self.path
        starts = np.array(self.starts, np.int64)

        def look_up(own: pa.Table, index: pa.Table) -> pa.Table:
            schema = arrow_schema("doc_id long, copy long, shard int, place long, n_tokens long")
            if not len(own) or not len(index):
                return schema.empty_table()
            known, shard, place, n = locate(index.to_pylist()[0], *(own.column(c).to_numpy() for c in ("doc_id", "copy")))
            return pa.table([own.column("doc_id"), own.column("copy"), pa.array(shard, pa.int32()), pa.array(place), pa.array(n)], schema=schema).filter(pa.array(known))

        keys = keys.withColumn("bucket", _bucket(self.n_buckets))
        found = keys.groupBy("bucket").cogroup(self.index().groupBy("bucket")).applyInArrow(look_up, "doc_id long, copy long, shard int, place long, n_tokens long")
        found = found.repartition(max(1, len(files)), "shard").sortWithinPartitions("shard", "place")

        def build():
            open_: dict[int, object] = {}

            def batch(b: pa.RecordBatch):
                ids, copy, shard, place, n = (b.column(i).to_numpy(zero_copy_only=False) for i in range(5))
                crc, raw = [], []
                for s, p, k in zip(shard.tolist(), place.tolist(), n.tolist(), strict=True):
                    if s not in open_:
                        for f in open_.values():
                            f.close()
                        open_.clear()
                        system, at = _filesystem(f"{path}/shards/{files[s]}")
                        open_[s] = system.open_input_file(at)
                    own = open_[s].read_at(k * width, p * width)
                    crc.append(zlib.crc32(np.frombuffer(own, f"<u{width}").astype("<u4").tobytes()))
                    raw.append(own)
                known = {"doc_id": pa.array(ids, mask=copy < 0), "start": pa.array(starts[shard] + place), "n_tokens": pa.array(n), "ids_crc32": crc}
                return known | ({"ids": raw} if with_ids else {})

            return batch

        return map_rows(found, {"doc_id": "long", "start": "long", "n_tokens": "long", "ids_crc32": "long"} | ({"ids": "binary"} if with_ids else {}), build)


def write_store(docs: DataFrame, tokenizer_path: str, end_id: int = 2, path: str | None = None, n_shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> TokenStore:
    """Encodes every document, appends end_id and writes the ids in ascending id order; returns the store.

    A null text is an empty one. Rows without id come first, told apart by their number; rows that share an id follow
    each other and are told apart by `copy`. An empty table gives a store without documents. Columns other than the
    two named are not read. Ids must be whole numbers (TypeError otherwise). Shards are range partitions of the id; each task streams its ids to a file of its own
    attempt, and only files named by the committed rows belong to the store, so repeated tasks do no harm. path must be
    a URI that pyarrow's file systems open on every executor (default: under the session's shared folder).
    """
    spark = docs.sparkSession
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"ids of a token store are whole numbers, not {docs.schema[id_col].dataType.simpleString()}")
    small_batches(spark)
    path = path or scratch_path(spark, "token-store")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ranged = own.repartitionByRange(*([n_shards] if n_shards else []), "doc_id").sortWithinPartitions("doc_id", "text")
    from tokenizers import Tokenizer

    width = 2 if max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1) <= 1 << 16 else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = word_tokens(tokenizer_path), int(end_id).to_bytes(4, "little")
        context = TaskContext.get()
        name = f"{context.partitionId():06d}-{context.taskAttemptId()}.ids"
        schema, place, last, copy = arrow_schema("doc_id long, copy long, part int, file string, place long, n_tokens long"), 0, None, -1
        file = None
        for b in batches:
            if file is None:
                system, at = _filesystem(f"{path}/shards/{name}")
                system.create_dir(posixpath.dirname(at), recursive=True)
                file = system.open_output_stream(at)
            ids, copies, places, sizes = b.column(0).to_pylist(), [], [], []
            for doc_id, text in zip(ids, b.column(1).to_pylist(), strict=True):
                raw = tokens.ids(text) + end
                file.write(np.frombuffer(raw, "<u4").astype(f"<u{width}").tobytes())
                copy = (copy - 1 if copy < 0 else -1) if doc_id is None else copy + 1 if doc_id == last and copy >= 0 else 0
                last = doc_id
                copies.append(copy)
                places.append(place)
                sizes.append(len(raw) // 4)
                place += len(raw) // 4
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(([i or 0 for i in ids], copies, [context.partitionId()] * len(ids), [name] * len(ids), places, sizes), schema, strict=True)], schema=schema)
        if file is not None:
            file.close()

    ranged.mapInArrow(run, "doc_id long, copy long, part int, file string, place long, n_tokens long").write.parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    shards = sorted(rows.groupBy("part", "file").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("rows")).collect())  # a row for each shard
    parts = [r["part"] for r in shards]
    starts = np.concatenate([[0], np.cumsum([r["n"] for r in shards])]).astype(int)[: len(shards)].tolist()
    n_buckets = max(1, -(-sum(r["rows"] for r in shards) // KEYS_PER_BUCKET))
    keyed = rows.withColumn("bucket", _bucket(n_buckets)).select("bucket", "doc_id", "copy", F.col("part").alias("shard"), "place", "n_tokens")
    keyed.groupBy("bucket").applyInArrow(_build_bucket, INDEX).write.parquet(f"{path}/index")
    # shards are numbered by partition; one without documents has no file
    files, first = [""] * (max(parts, default=-1) + 1), [0] * (max(parts, default=-1) + 1)
    for r, start in zip(shards, starts, strict=True):
        files[r["part"]], first[r["part"]] = r["file"], start
    return TokenStore(spark, path, files, first, width, n_buckets)
