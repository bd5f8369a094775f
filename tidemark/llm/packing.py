"""Best-fit packing of token sequences in bulk-synchronous steps over size classes.

Lengths are integers up to the capacity, so documents and gaps range-sort into at most `capacity` classes. A superstep
takes the next lower class of pieces; its successor sweep finds the class of the smallest gap that fits; pieces and
gaps of the two classes match by rank, which settles all conflicts at once (a gap takes pieces as long as they fit, as
best-fit would); the matched gaps move to their new class; the step repeats until the class is used up, opening new
sequences where no gap fits. A step moves whole runs of equal
gaps, so the plan has a few runs for each class and never depends on the number of documents: the steps need only the
histogram of lengths (at most `capacity` rows), while tokenizing, ranking and placing stay distributed and move no text.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import map_rows, small_batches, types_of
from tidemark.llm.word_tokens import word_tokens
from tidemark.plans.scratch import written


def plan_runs(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: from that rank on, pieces of that length go to
    consecutive sequences from the first one, at that offset. Best-fit decreasing."""
    runs: list[tuple[int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    classes: list[int] = []
    opened = 0

    def put(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                insort(classes, gap)
            gaps[gap].append((first, n))

    def fill(first: int, n: int, gap: int, length: int, rank: int, left: int) -> tuple[int, int]:
        """Pieces of one length into n sequences of one gap, each filled as far as it goes; the rank after them, sequences used."""
        each = gap // length
        full, rest = divmod(min(left, n * each), each)
        for j in range(each):
            if full:
                runs.append((length, rank, first, capacity - gap + j * length))
                rank += full
        put(gap - each * length, first, full)
        for j in range(rest):
            runs.append((length, rank, first + full, capacity - gap + j * length))
            rank += 1
        if rest:
            put(gap - rest * length, first + full, 1)
        return rank, full + (rest > 0)

    for length in sorted(counts, reverse=True):
        count, rank = counts[length], 0
        while rank < count:
            at = bisect_left(classes, length)
            if at < len(classes):
                gap = classes[at]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], classes[at]
                rank, used = fill(first, n, gap, length, rank, count - rank)
                put(gap, first + used, n - used)
            else:
                rank, used = fill(opened, count, capacity, length, rank, count - rank)
                opened += used
    return np.array(sorted(runs), np.int64).reshape(-1, 4)


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: id, piece, start, length, ids_crc32, slice (of the task) and rank (in slice and length)."""

    def build():
        tokens, end = word_tokens(tokenizer_path), int(end_id).to_bytes(4, "little")
        seen: dict[int, int] = {}
        part = TaskContext.get().partitionId()

        def batch(b: pa.RecordBatch):
            out = {c: [] for c in ("row", "piece", "start", "length", "ids_crc32", "rank")}
            for i, text in enumerate(b.column(1).to_pylist()):
                ids = tokens.ids(text) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    n = len(own) // 4
                    for c, v in zip(out, (i, piece, at // 4, n, zlib.crc32(own), seen.get(n, 0)), strict=True):
                        out[c].append(v)
                    seen[n] = seen.get(n, 0) + 1
            rows = out.pop("row")
            return out | {id_col: b.column(0).take(pa.array(rows, pa.int64())), "slice": [part] * len(rows)}

        return batch

    kind = types_of(docs)[id_col]
    return map_rows(docs.select(id_col, text_col), {id_col: kind, "piece": "int", "start": "long", "length": "long", "ids_crc32": "long", "slice": "int", "rank": "long"}, build, keeps=tokenizer_path)


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs every document's ids, with end_id appended, into sequences of at most `capacity` tokens.

    Only longer documents are cut, into pieces of `capacity` ids and a last one. Returns a row for each piece: id, piece,
    start, length, ids_crc32, sequence_id, offset. A null text is an empty one (one id, the end); null ids and repeated
    rows are packed like any other; an empty table gives no rows. Columns other than the two named are not read. Equal
    lengths are matched by rank in the written table of pieces, so a lost executor repeats the same places.
    """
    small_batches(docs.sparkSession)
    pieces = written(token_pieces(docs, tokenizer_path, end_id, capacity, id_col, text_col), "pieces")
    cells = pieces.groupBy("slice", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    cells = written(cells.withColumn("before", F.coalesce(before, F.lit(0))), "cells")
    counts = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = plan_runs(counts, capacity)
    ranked = pieces.join(cells.select("slice", "length", "before"), ["slice", "length"]).withColumn("rank", F.col("rank") + F.col("before"))
    names = [id_col, "piece", "start", "length", "ids_crc32"]
    kinds = types_of(pieces)

    def build():
        # one sorted key for (length, rank): the rank's order within each length's runs
        starts = {int(n): (runs[lo:hi, 1], runs[lo:hi]) for n in np.unique(runs[:, 0]) for lo, hi in [np.searchsorted(runs[:, 0], [n, n + 1])]}

        def batch(b: pa.RecordBatch):
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            seq, off = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                first, own = starts[int(n)]
                k = np.searchsorted(first, rank[at], side="right") - 1
                seq[at], off[at] = own[k, 2] + rank[at] - own[k, 1], own[k, 3]
            return {c: b.column(b.schema.get_field_index(c)) for c in names} | {"sequence_id": pa.array(seq), "offset": pa.array(off)}

        return batch

    return map_rows(ranked, {c: kinds[c] for c in names} | {"sequence_id": "long", "offset": "long"}, build)
