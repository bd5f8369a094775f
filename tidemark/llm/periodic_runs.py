"""Periodic runs of words by bit-parallel lags.

Word ids lie in bit planes, each one big integer with a bit for each word. A plane XORed with itself shifted by q shows
where it differs from the word q further on; the planes' differences are ORed, and the zeros of the result are the words that repeat at
lag q. Shift-doubling ANDs keep the starts of zero stretches that are long enough, and only these become runs.

Most lags are skipped beforehand, none that has a run. A run of period q repeats at least max(12 - q, q) words in a row at lag q, so a
gram of so many words occurs twice, q apart: lags of [g, 2g) are looked at only where a gram of g words occurs twice less than 2g
apart, and a lag q of these only where a gram of g / 2 words, begun at one of every q - g / 2 + 1 words, occurs again q later, outside
of a run already found whose period divides q (by Fine and Wilf's theorem, what lies inside has no smallest period q).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.shared import map_rows, small_batches, types_of, words_of

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
#: Least length of a run; half of it is the least gram that any run repeats.
LEAST = 12


def word_ids(words: list[bytes]) -> np.ndarray:
    """0 for the first word and those equal to it, 1 for the next new one, and so on."""
    ids: dict[bytes, int] = {}
    return np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))


def bit_planes(ids: np.ndarray) -> list[int]:
    """For each bit of the ids, an integer whose bit i is that bit of the i-th id."""
    n_bits = int(ids.max()).bit_length() if len(ids) else 0
    return [int.from_bytes(np.packbits((ids >> b & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for b in range(n_bits)]


def stretches(planes: list[int], n: int, lag: int, least: int) -> list[tuple[int, int]]:
    """(first, end) of each maximal stretch of at least `least` words that are equal to the words `lag` further on."""
    differs = 0
    for p in planes:
        differs |= p ^ (p >> lag)
    starts = ~differs & ((1 << (n - lag)) - 1)
    have = 1
    while have < least and starts:
        step = min(have, least - have)
        starts &= starts >> step
        have += step
    if not starts:
        return []
    bits = np.unpackbits(np.frombuffer(starts.to_bytes((n + 7) // 8, "little"), np.uint8), bitorder="little")
    edge = np.diff(np.concatenate([[0], bits.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) + least - 1).tolist(), strict=True))


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of pairs."""
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (a >> np.uint64(31))
    x = (x + b) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _twice_within(grams: np.ndarray, reach: int) -> tuple[bool, bool]:
    """Whether any gram occurs twice, and whether any does so less than reach apart."""
    order = np.argsort(grams, kind="stable")
    same = np.flatnonzero(grams[order[1:]] == grams[order[:-1]])
    return bool(len(same)), bool(len(same)) and int((order[same + 1] - order[same]).min()) < reach


def find_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of each maximal run of its smallest period and at least max(12, 2 * period) words, by start, then period."""
    n, found, planes = len(ids), [], []
    if n < LEAST:
        return found

    def look(lag: int) -> None:
        if not planes:
            planes.extend(bit_planes(ids))
        for first, end in stretches(planes, n, lag, max(LEAST - lag, lag)):
            length = end - first + lag
            if not any(lag % p == 0 and s <= first and first + length <= s + k for s, k, p in found):
                found.append((first, length, lag))

    one = _joined(ids.astype(np.uint64), np.uint64(1))
    three = _joined(_joined(one[:-2], one[1:-1]), one[2:])
    half, grams, g = three, _joined(three[:-3], three[3:]), LEAST // 2
    some, near = _twice_within(grams, LEAST)
    if near:
        for lag in range(1, min(LEAST, n)):
            look(lag)
    while some and 4 * g <= n:
        half, grams, g = grams, _joined(grams[:-g], grams[g:]), 2 * g
        some, near = _twice_within(grams, 2 * g)
        for lag in range(g, min(2 * g, n // 2 + 1)) if near else ():
            step = lag - g // 2 + 1
            hits = np.flatnonzero(half[: len(half) - lag : step] == half[lag::step]) * step
            for s, k, p in found:
                if len(hits) and k > lag and lag % p == 0:
                    hits = hits[(hits < s) | (hits + lag >= s + k)]
            if len(hits):
                look(lag)
    return sorted((s, k, p) for s, k, p in found)


def dropped(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Whether a run holds each of n words after the run's first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) > 0


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words long, runs (start, length, period; by start, then period), collapsed string (the words outside of repeats, joined by a space).

    A null, empty or blank text has no words and no runs, and its collapsed text is empty; texts of any length are read whole; repeated
    rows and null ids give rows like any other; an empty table gives none. Other columns are not read, whatever their names. Map-only.
    """
    small_batches(docs.sparkSession)

    def build():
        def batch(b: pa.RecordBatch):
            n_words, runs, collapsed = [], [], []
            for text in b.column(1).to_pylist():
                words = words_of(text)
                own = find_runs(word_ids(words))
                if own:
                    words_left = [w for w, gone in zip(words, dropped(len(words), own).tolist(), strict=True) if not gone]
                else:
                    words_left = words
                n_words.append(len(words))
                runs.append([{"start": s, "length": k, "period": p} for s, k, p in own])
                collapsed.append(b" ".join(words_left).decode())
            return {id_col: b.column(0), "n_words": n_words, "runs": runs, "collapsed": collapsed}

        return batch

    kind = types_of(docs)[id_col]
    return map_rows(docs.select(id_col, text_col), {id_col: kind, "n_words": "long", "runs": RUNS, "collapsed": "string"}, build)
