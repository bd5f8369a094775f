"""Helpers that the corpus operators share: word rules and Arrow plumbing."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType, StructField, StructType

#: A word, for both Java's and DuckDB's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes that one Arrow batch of whole texts may hold in a Python worker; a longer text is a batch of its own.
BATCH_BYTES = 4 << 20
#: Bytes whose words are hashed at once; a word of half as many or more is hashed by itself.
CHUNK_BYTES = 1 << 20


def free_name(name: str, taken: list[str]) -> str:
    """name, with underscores added until no column is called so (Spark's names ignore case)."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name


def small_batches(spark: SparkSession) -> None:
    """Bounds the bytes of an Arrow batch.

    Spark reads this setting when a plan runs, so it has to stay in the session while the results are lazy; a smaller
    bound of the caller's is kept.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, str((1 << 31) - 2)).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


_kept: dict = {}


def kept(key, make):
    """make() of the key, kept by this worker process for later tasks; what it kept of another key goes before."""
    forget(key)
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def forget(key=None) -> None:
    """Drops what this worker process keeps, but for that of the key: workers live on, and serve other operators next."""
    if key not in _kept:
        _kept.clear()


def give_back() -> None:
    """Free memory of this worker process goes to the system; workers live on, and would keep what their largest task took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def n_words(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words_of(text: str | None) -> list[bytes]:
    """Words as UTF-8: bytes.split() splits at exactly the six ASCII white-space characters of WORD."""
    return text.encode("utf-8").split() if text else []


_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r\f\v")] = True
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 14, 1 << (n - 1).bit_length())
        steps = [np.full(size, b, np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
        for x in steps:
            x[0] = 1
        _powers[:] = [np.cumprod(x) for x in steps]
    return _powers[0][:n], _powers[1][:n]


def _short_hashes(data: bytes) -> np.ndarray:
    own = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(own) + 2, np.int8)
    inside[1:-1] = ~_SPACE[own]
    edge = np.diff(inside)
    first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = powers(len(own))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own * up)])
    x = (sums[end] - sums[first]) * down[first]
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    for i in np.flatnonzero(end - first >= CHUNK_BYTES // 2):
        x[i] = _long_hash(data[first[i] : end[i]])
    return x


def _long_hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word, 7)


def word_hashes(data: bytes) -> np.ndarray:
    """64 bits for each word of data.split(), all words at once: a polynomial of the word's bytes, finalized."""
    out, at = [np.empty(0, np.uint64)], 0
    while at < len(data):
        end = at + CHUNK_BYTES
        if end < len(data):
            end = max(data.rfind(c, at, end) for c in (b" ", b"\t", b"\n", b"\r", b"\f", b"\v"))
            if end <= at:  # no white space but, maybe, the first byte: a word of the length of a chunk
                word = data[at:].split(None, 1)[0]
                out.append(np.array([_long_hash(word)], np.uint64))
                at = data.index(word, at) + len(word)
                continue
        out.append(_short_hashes(data[at:end]))
        at = end
    return np.concatenate(out)


def text_keys(text: str) -> list[Column]:
    """128 bits that stand for a text: two XXH64 of different seeds."""
    return [F.xxhash64(text), F.xxhash64(F.lit(1), text)]


def shards(batches, n_keys: int, work):
    """Yields work(table, starts) for whole shards, where dealt rows come sorted by their first n_keys columns in each task.

    starts: the first row of each shard in the table. Only the last shard of a batch waits for the next one.
    """
    forget()
    yield from _whole(batches, n_keys, work)
    give_back()


def _whole(batches, n_keys: int, work):
    held: list[pa.RecordBatch] = []

    def same(a: pa.RecordBatch, b: pa.RecordBatch) -> bool:
        return all(a.column(i)[-1].as_py() == b.column(i)[0].as_py() for i in range(n_keys))

    def done(parts: list[pa.RecordBatch]):
        table = pa.Table.from_batches(parts).combine_chunks()
        return work(table, np.concatenate([[0], _moves(table, n_keys)]).astype(np.int64))

    for batch in batches:
        if not len(batch):
            continue
        cuts = _moves(batch, n_keys)
        if held and not same(held[-1], batch):
            cuts = np.append(0, cuts)
        if len(cuts):
            cut = int(cuts[-1])
            if parts := held + ([batch.slice(0, cut)] if cut else []):
                yield done(parts)
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield done(held)


def _moves(rows, n_keys: int) -> np.ndarray:
    """Rows that differ from the row before in one of the first n_keys columns."""
    keys = [rows.column(i).to_numpy() if isinstance(rows, pa.Table) else rows.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys)]
    return np.flatnonzero(np.any([np.diff(k) != 0 for k in keys], axis=0)) + 1


def lists(parts: list[np.ndarray]) -> pa.Array:
    """A list of 64-bit integers for each of the arrays."""
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int64), *(p.view(np.int64) for p in parts)])))


def driver_rows(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """Rows that the driver has, through Arrow: from a list, createDataFrame starts Python workers of another kind in the executors, which stay."""
    kind = StructType.fromDDL(ddl)
    columns = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(to_arrow_schema(kind))]
    return spark.createDataFrame(pa.Table.from_arrays(columns, names=kind.names), kind)


def types_of(df: DataFrame) -> dict[str, DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}


def _arrow_type(kind: str) -> pa.DataType:
    return pa.list_(_arrow_type(kind[6:-1])) if kind.startswith("array<") else _ARROW[kind]


def arrow_schema(ddl: str) -> pa.Schema:
    """Of columns of simple types and arrays of them; needs no session, so executors can call it."""
    return pa.schema([pa.field(n, _arrow_type(k)) for n, k in (x.split(" ", 1) for x in ddl.split(", "))])


def map_rows(df: DataFrame, columns: dict[str, str | DataType], build, keeps=None) -> DataFrame:
    """mapInArrow whose function turns one batch into lists by column.

    columns: name to type of the result. build() is called once in each task and returns a function from a
    RecordBatch to {column: values}. Arrays that it passes on from the batch keep their type, whatever it is.
    keeps: the key of what build() gets from kept(), if anything.
    """
    plain = lambda k: StructType.fromDDL(f"x {k}")["x"].dataType if isinstance(k, str) else k
    result = StructType([StructField(name, plain(kind)) for name, kind in columns.items()])
    schema = to_arrow_schema(result)

    def rows(batches):
        made = build()
        for batch in batches:
            got = made(batch)
            own = [x if isinstance(x := got[f.name], pa.Array) else pa.array(x, f.type) for f in schema]
            yield pa.RecordBatch.from_arrays(own, names=schema.names)

    def run(batches):
        forget(keeps)
        yield from rows(batches)  # what it holds goes with its frame
        give_back()

    return df.mapInArrow(run, result)
