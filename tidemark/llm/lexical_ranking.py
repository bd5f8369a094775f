"""Ranked lexical search: documents one at a time, by a heap merge over compressed postings in order of id.

Each task inverts its documents, `SHARD_DOCS` at a time, into postings of the terms that the queries hold: for each term the documents'
numbers within the shard, ascending, as gaps, and the term's counts, both in variable-length bytes. A query opens a cursor for each of
its terms, and a heap of cursors brings the documents up in order; the results are a heap of k, keyed by score, then id. Terms whose
largest scores together stay below the k-th best score so far bring up no documents of their own: they are looked up only for those that the others bring
up (an exact rule: what is left out cannot reach the k-th score). Tasks keep k documents a query; windows merge them.

Weights need counts over all documents, so texts are read once into a written table of (id, number of terms, the queries' terms
that occur, their counts), from which counts, document frequencies and postings come.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from tidemark.llm.shared import free_name, map_rows, small_batches, types_of
from tidemark.plans.scratch import drop, written

#: Documents whose postings are in memory at once.
SHARD_DOCS = 16_384
#: Bytes of query text whose terms are sent to the tasks at once; more queries take turns in blocks.
BLOCK_BYTES = 4 << 20
#: Tasks at most; each goes through its shards in turn.
MAX_TASKS = 20_000
#: Groups of tasks whose results are merged before all are.
GROUPS = 64

_TERM = bytes(range(0x30, 0x3A)) + bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_TABLE = bytes(ord(" ") if b not in _TERM else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and characters beyond ASCII, A-Z in lower case, as UTF-8."""
    return text.encode().translate(_TABLE).split() if text else []


def packed(values: np.ndarray) -> bytes:
    """Numbers from 0 in bytes of seven bits, the lowest first; the last byte of each is under 128."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    for k in range(1, 9):
        size += values >= np.uint64(1 << 7 * k)
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(size.max()) if len(size) else 0):
        own = size > k
        at = ends[own] - size[own] + k
        out[at] = (values[own] >> np.uint64(7 * k) & np.uint64(127)).astype(np.uint8) + 128 * (size[own] > k + 1)
    return out.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    own = np.frombuffer(data, np.uint8)
    if not len(own):
        return np.empty(0, np.int64)
    last = np.flatnonzero(own < 128)
    first = np.concatenate([[0], last[:-1] + 1])
    place = np.arange(len(own)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((own & 127).astype(np.int64) << (7 * place), first)


class Shard:
    """Postings of a shard's documents, which come in order of id: by term, packed gaps and counts."""

    def __init__(self, lengths: np.ndarray, owners: np.ndarray, terms: np.ndarray, counts: np.ndarray, n_docs: int, n_terms: int):
        """lengths: terms of each document. owners (ascending), terms, counts: a document's number, a term's, and how often it holds it."""
        #: m, the document's share of the divisor, in thousandths of the mean length.
        self.norms = 50 + 50 * lengths * n_docs // n_terms
        order = np.argsort(terms, kind="stable")
        owners, terms, counts = owners[order], terms[order], counts[order]
        cuts = np.flatnonzero(np.diff(terms)) + 1
        self.lists = {int(t[0]): (packed(np.diff(o, prepend=0)), packed(c)) for o, t, c in zip(np.split(owners, cuts), np.split(terms, cuts), np.split(counts, cuts), strict=True) if len(t)}
        self.opened: dict[int, tuple] = {}

    def open(self, term: int, weight: int):
        """(documents, scores, largest score) of a term, or None where no document has it or its weight is 0."""
        if term not in self.opened:
            found = self.lists.get(term)
            if found and weight:
                docs, counts = np.cumsum(unpacked(found[0])), unpacked(found[1])
                scores = weight * (1_000_000_000 * counts // (1000 * counts + 20 * self.norms[docs]))
                self.opened[term] = memoryview(docs), memoryview(scores), int(scores.max())
            else:
                self.opened[term] = None
        return self.opened[term]

    def best(self, terms: list[int], weights: list[int], k: int, floor: int) -> list[tuple[int, int]]:
        """(score, document) of the k best with score above 0 and at least floor, in no order; equal scores: the smaller documents."""
        lists = sorted((x for t in terms if (x := self.open(t, weights[t]))), key=lambda x: x[2])
        upto = [0]
        for x in lists:
            upto.append(upto[-1] + x[2])
        top: list[tuple[int, int]] = []
        below, floor = 0, max(floor, 1)
        while below < len(lists) and upto[below + 1] < floor:
            below += 1
        at = [0] * len(lists)
        cursors = [(lists[i][0][0], i) for i in range(below, len(lists))]
        heapq.heapify(cursors)
        while cursors:
            doc, score = cursors[0][0], 0
            while cursors and cursors[0][0] == doc:
                i = cursors[0][1]
                if i < below:
                    heapq.heappop(cursors)
                    continue
                docs, scores, _ = lists[i]
                score += scores[at[i]]
                at[i] += 1
                if at[i] < len(docs):
                    heapq.heapreplace(cursors, (docs[at[i]], i))
                else:
                    heapq.heappop(cursors)
            if not score:
                continue
            for i in range(below - 1, -1, -1):
                if score + upto[i + 1] < floor:
                    break
                docs, scores, _ = lists[i]
                at[i] = bisect_left(docs, doc, at[i])
                if at[i] < len(docs) and docs[at[i]] == doc:
                    score += scores[at[i]]
            if score < floor:
                continue
            if len(top) < k:
                heapq.heappush(top, (score, -doc))
            elif (score, -doc) > top[0]:
                heapq.heapreplace(top, (score, -doc))
            if len(top) == k and top[0][0] > floor:
                floor = top[0][0]
                while below < len(lists) and upto[below + 1] < floor:
                    below += 1
        return [(s, -d) for s, d in top]


def _blocks(queries: DataFrame, id_col: str, text_col: str):
    """Lists of (id, text), each of some BLOCK_BYTES of texts; all rows of an id are in one."""
    size = queries.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    n = size // BLOCK_BYTES + 1
    for i in range(n):
        yield queries.where(F.pmod(F.xxhash64(id_col), F.lit(n)) == i).select(id_col, text_col).where(F.col(text_col).isNotNull()).collect()


def _indexed(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """id, n, terms, counts of every document with terms: which of the vocabulary it holds, and how often."""

    def build():
        def batch(b: pa.RecordBatch):
            rows, n, terms, counts = [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                own = terms_of(text)
                if not own:
                    continue
                held: dict[int, int] = {}
                for t in map(vocabulary.get, own):
                    if t is not None:
                        held[t] = held.get(t, 0) + 1
                rows.append(i)
                n.append(len(own))
                terms.append(list(held))
                counts.append(list(held.values()))
            return {id_col: b.column(0).take(pa.array(rows, pa.int64())), "n": n, "terms": terms, "counts": counts}

        return batch

    kind = types_of(docs)[id_col]
    return map_rows(docs.select(id_col, text_col), {id_col: kind, "n": "long", "terms": "array<int>", "counts": "array<int>"}, build)


def _order(i: tuple) -> tuple:
    """A row's place among equal scores: ids ascending, null last."""
    return (-i[0], i[1] is None, i[1])


def rank(docs: DataFrame, queries: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", query_id_col: str = "item_id", query_text_col: str = "text") -> DataFrame:
    """query id, rank int (from 1), id, score long: each query's k documents of highest score above 0, equal scores by ascending id.

    A term counts once in a query; rows of one query id are one query of all their terms. Null texts and those without terms match
    nothing and do not count as documents; repeated rows are documents of their own; null ids come last among equal scores; where docs or queries
    are empty there are no rows. Columns are read by the given names only, whatever the others are called.
    """
    spark = docs.sparkSession
    small_batches(spark)
    key = free_name("doc_id" if id_col == query_id_col else id_col, [query_id_col, "rank", "score", "part"])
    result = StructType([StructField(query_id_col, types_of(queries)[query_id_col]), StructField(key, types_of(docs)[id_col]), StructField("score", StructType.fromDDL("x long")["x"].dataType), StructField("part", StructType.fromDDL("x int")["x"].dataType)])
    found = None
    for block in _blocks(queries, query_id_col, query_text_col):
        vocabulary: dict[bytes, int] = {}
        items: dict = {}
        for i, text in block:
            items.setdefault(i, {}).update((vocabulary.setdefault(t, len(vocabulary)), None) for t in terms_of(text))
        items = {i: list(own) for i, own in items.items() if own}
        if items:
            part = _search(spark, docs, items, vocabulary, k, id_col, text_col, result)
            found = part if found is None else found.union(part)
    found = spark.createDataFrame([], result) if found is None else found
    best = lambda *by: Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col(key).asc_nulls_last())
    some = found.withColumn("rank", F.row_number().over(best(query_id_col, "part"))).where(F.col("rank") <= k).drop("rank")
    ranked = some.withColumn("rank", F.row_number().over(best(query_id_col))).where(F.col("rank") <= k)
    return ranked.select(query_id_col, "rank", key, "score")


def _search(spark: SparkSession, docs: DataFrame, items: dict, vocabulary: dict[bytes, int], k: int, id_col: str, text_col: str, result: StructType) -> DataFrame:
    """Each task's best k of each item."""
    index = written(_indexed(docs, vocabulary, id_col, text_col), "lexical-index")
    n_docs, n_terms = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_docs:
        drop(index)
        return spark.createDataFrame([], result)
    weights = [0] * len(vocabulary)
    for term, df in index.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():
        weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    names, wanted = pa.array(list(items), to_arrow_schema(result).field(0).type), list(items.values())
    schema = to_arrow_schema(result)

    def run(batches):
        top: list[list[tuple]] = [[] for _ in wanted]
        held, n = [], 0

        def search() -> None:
            rows = pa.Table.from_batches(held)
            rows = rows.take(pc.sort_indices(rows.column(0), null_placement="at_end")).combine_chunks()
            terms, counts = rows.column(2).combine_chunks(), rows.column(3).combine_chunks()
            owners = np.repeat(np.arange(len(rows)), pc.list_value_length(terms).to_numpy(zero_copy_only=False))
            shard = Shard(rows.column(1).to_numpy(), owners, terms.flatten().to_numpy(), counts.flatten().to_numpy().astype(np.int64), n_docs, n_terms)
            ids = rows.column(0)
            for own, query in zip(top, wanted, strict=True):
                new = shard.best(query, weights, k, own[-1][0] if len(own) == k else 0)
                if new:
                    own[:] = sorted([*own, *((s, ids[d].as_py()) for s, d in new)], key=_order)[:k]

        for batch in batches:
            at = 0
            while at < len(batch):
                piece = batch.slice(at, SHARD_DOCS - n)
                held.append(piece)
                at, n = at + len(piece), n + len(piece)
                if n == SHARD_DOCS:
                    search()
                    held, n = [], 0
        if n:
            search()
        where = np.repeat(np.arange(len(wanted)), [len(own) for own in top])
        flat = [x for own in top for x in own]
        group = pa.array(np.full(len(flat), _partition() % GROUPS, np.int32))
        yield pa.RecordBatch.from_arrays([names.take(pa.array(where)), pa.array([i for _, i in flat], schema.field(1).type), pa.array([s for s, _ in flat], pa.int64()), group], names=schema.names)

    tasks = min(MAX_TASKS, -(-n_docs // SHARD_DOCS))
    return index.repartition(int(tasks)).mapInArrow(run, result)


def _partition() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()
