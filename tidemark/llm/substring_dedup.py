"""Exact substring dedup: words under any window of `window` words whose sequence starts anywhere else are removed.

Three steps, none of which compares all with all:

1. Anchors. Of the 18-word hashes inside each 35-word window, the smallest is the window's anchor. Equal windows have equal
   anchors, so only windows whose anchor occurs twice can repeat. An anchor owns consecutive windows; about a
   tenth of all positions are anchors. Equal texts (by 128-bit hash) count once here: if a text occurs twice, all of it repeats.
2. Matching. For each anchor that occurs again, the fragment of words that its windows cover goes to the reference shard
   of that anchor. A shard builds the suffix automaton of its distinct fragments, with the number of places of each
   state, and streams each fragment through it: the matching statistics tell at each word whether the window that ends there
   has another place. This compares words, not hashes. Anchors with over HOT places are not gathered in a shard:
   their fragments, and the windows of fragments that occur once, are counted by 128-bit hash with pre-aggregation. Either
   way every window that has another place is found; two different windows pass for one with a chance of 2^-128 a pair.
3. Removal. Spans meet their texts by text hash; every word under a repeated window goes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import arrow_schema, free_name, lists, map_rows, shards, small_batches, text_keys, types_of, word_hashes, words_of
from tidemark.plans.scratch import scope, written

#: Places of an anchor above which its fragments are counted by hash, so that no task gathers them.
HOT = 200
_BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if which not in _powers or len(_powers[which][0]) < n:
        base, size = _BASES[which], max(1 << 14, 1 << (n - 1).bit_length())
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            made.append(np.cumprod(steps))
        _powers[which] = (made[0], made[1])
    return _powers[which]


def run_hashes(words: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """A hash of each run of k words."""
    n = len(words)
    up, down = _power(which, n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[:n])])
    x = (sums[k:] - sums[:-k]) * down[: n - k + 1]
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def anchors(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, number of windows) of each anchor, in order."""
    if len(words) < window:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    k = window // 2 + 1
    h = run_hashes(words, k)
    wide, n = window - k + 1, len(words) - window + 1
    least = np.empty(n, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(h, wide)
    for at in range(0, n, 1 << 16):
        own = view[at : at + (1 << 16)]
        least[at : at + len(own)] = np.argmin(own, axis=1) + np.arange(at, at + len(own))
    first = np.flatnonzero(np.concatenate([[True], np.diff(least) != 0]))
    return h[least[first]].view(np.int64), first, np.diff(np.append(first, n))


class SuffixAutomaton:
    """Of several word sequences, each with the number of its places."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.size, self.places = [-1], [0], [0]

    def add(self, words: list, places: int) -> None:
        last = 0
        for w in words:
            last = self._extend(last, w)
            self.places[last] += places

    def _state(self, size: int, link: int, following: dict) -> int:
        self.next.append(following)
        self.link.append(link)
        self.size.append(size)
        self.places.append(0)
        return len(self.size) - 1

    def _split(self, p: int, q: int, w) -> int:
        copy = self._state(self.size[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, w) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.size[q] == self.size[last] + 1 else self._split(last, q, w)
        new = self._state(self.size[last] + 1, 0, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, q, w)
        return new

    def count(self) -> None:
        """Adds up the places of each state; call once, after all sequences."""
        for s in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            self.places[self.link[s]] += self.places[s]

    def repeats(self, words: list, window: int) -> list[bool]:
        """By window of the words: does its sequence have a second place? Streams the words' matching statistics."""
        out, state, matched = [], 0, 0
        for i, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                matched = self.size[state]
            if w in self.next[state]:
                state, matched = self.next[state][w], matched + 1
            while state and self.size[self.link[state]] >= window:
                state = self.link[state]
            matched = min(matched, self.size[state])
            if i >= window - 1:
                out.append(matched >= window and self.places[state] > 1)
        return out


def shard_spans(fragments: list[tuple[bytes, int]], window: int) -> dict[bytes, list[tuple[int, int]]]:
    """fragments: (words joined by a space, places). By fragment, runs (first window, number) of repeated windows."""
    if len(fragments) == 1:
        words, places = fragments[0]
        return {words: [(0, words.count(b" ") + 2 - window)] if places > 1 else []}
    automaton = SuffixAutomaton()
    split = [f.split(b" ") for f, _ in fragments]
    for words, (_, places) in zip(split, fragments, strict=True):
        automaton.add(words, places)
    automaton.count()
    out = {}
    for (f, _), words in zip(fragments, split, strict=True):
        hits = np.flatnonzero(automaton.repeats(words, window))
        cuts = np.split(hits, np.flatnonzero(np.diff(hits) != 1) + 1) if len(hits) else []
        out[f] = [(int(c[0]), len(c)) for c in cuts]
    return out


def repeated_spans(docs: DataFrame, window: int) -> DataFrame:
    """By text hash (_h, _g) of docs (id, text): copies, and the repeated spans as lists starts, counts."""
    id_col, text_col = "id", "text"
    hashed = docs.withColumns(dict(zip(("_h", "_g"), text_keys(text_col), strict=True)))

    def find():
        def batch(b: pa.RecordBatch):
            found = [anchors(word_hashes((t or "").encode()), window)[0] for t in b.column(3).to_pylist()]
            return {"_h": b.column(0), "_g": b.column(1), "id": b.column(2), "anchors": lists(found)}

        return batch

    kind = types_of(docs)[id_col]
    found = map_rows(hashed.where(F.col(text_col).isNotNull()).select("_h", "_g", F.col(id_col).alias("id"), text_col), {"_h": "long", "_g": "long", "id": kind, "anchors": "array<long>"}, find)
    # equal texts once: the one of the least id stands for all
    texts = written(found.where(F.size("anchors") > 0).groupBy("_h", "_g").agg(F.count("*").alias("copies"), F.min("id").alias("id"), F.first("anchors").alias("anchors")), "texts")
    places = texts.select("_h", "_g", F.explode("anchors").alias("anchor"))
    again = places.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1")
    wanted = places.distinct().join(again, "anchor").groupBy("_h", "_g").agg(
        F.collect_list(F.when(F.col("n") <= HOT, F.col("anchor"))).alias("some"), F.collect_list(F.when(F.col("n") > HOT, F.col("anchor"))).alias("many")
    )
    wanted = written(texts.select("_h", "_g", "id").join(wanted, ["_h", "_g"]), "wanted")
    chosen = hashed.select("_h", "_g", F.col(id_col).alias("_id"), text_col).join(wanted, ["_h", "_g"]).where(F.col("_id").eqNullSafe(F.col("id")))

    def fragments():
        def batch(b: pa.RecordBatch):
            out = {c: [] for c in ("anchor", "_h", "_g", "at", "words")}
            for h, g, text, some in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                words = words_of(text)
                hashes, first, n = anchors(word_hashes(text.encode()), window)
                for i in np.flatnonzero(np.isin(hashes, some)):
                    lo = int(first[i])
                    for c, v in zip(out, (int(hashes[i]), h, g, lo, b" ".join(words[lo : lo + int(n[i]) + window - 1])), strict=True):
                        out[c].append(v)
            return out

        return batch

    def pieces():
        def batch(b: pa.RecordBatch):
            # a row for each text and distinct fragment of a hot anchor, with its places in that text and its windows' hashes
            parts: dict[str, list] = {c: [np.empty(0, np.int64)] for c in ("anchor", "w", "_h", "_g")}
            places, ws = [], []
            for h, g, text, many in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                own = word_hashes(text.encode())
                hashes, first, n = anchors(own, window)
                w = run_hashes(own, window, 1).view(np.int64) if len(own) >= window else own
                found: dict[tuple[int, bytes], list[int]] = {}
                for i in np.flatnonzero(np.isin(hashes, many)):
                    lo, hi = int(first[i]), int(first[i] + n[i])
                    found.setdefault((int(hashes[i]), w[lo:hi].tobytes()), []).append(lo)
                places += [np.array(at, np.int64) for at in found.values()]
                ws += [np.frombuffer(x, np.int64) for _, x in found]
                keys = [int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True) for _, x in found]
                for c, x in zip(parts, ([a for a, _ in found], keys, [h] * len(found), [g] * len(found)), strict=True):
                    parts[c].append(np.array(x, np.int64))
            flat = {c: pa.array(np.concatenate(x)) for c, x in parts.items()}
            return flat | {"at": lists(places), "ws": lists(ws)}

        return batch

    cold = map_rows(chosen.where(F.size("some") > 0).select("_h", "_g", text_col, "some"), {"anchor": "long", "_h": "long", "_g": "long", "at": "long", "words": "binary"}, fragments)

    def match(batches):
        schema = arrow_schema("_h long, _g long, at long, n long")

        def work(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
            h, g, at, words = (rows.column(c).to_pylist() for c in ("_h", "_g", "at", "words"))
            out = ([], [], [], [])
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(h)], strict=True):
                places: dict[bytes, int] = {}
                for w in words[lo:hi]:
                    places[w] = places.get(w, 0) + 1
                spans = shard_spans(list(places.items()), window)
                for i in range(lo, hi):
                    for first, n in spans[words[i]]:
                        for c, v in zip(out, (h[i], g[i], at[i] + first, n), strict=True):
                            c.append(v)
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)

        return shards(batches, 1, work)

    spans = cold.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(match, "_h long, _g long, at long, n long")
    # the anchor's hash and another of the fragment, or of the window, make 128 bits
    hot = written(map_rows(chosen.where(F.size("many") > 0).select("_h", "_g", text_col, "many"), {"anchor": "long", "w": "long", "_h": "long", "_g": "long", "at": "array<long>", "ws": "array<long>"}, pieces), "pieces")
    kinds = hot.groupBy("anchor", "w").agg(F.sum(F.size("at")).alias("c"), *[F.first(x).alias(x) for x in ("ws", "_h", "_g", "at")])
    kinds = written(kinds, "kinds")
    # a fragment that occurs twice repeats in whole; the windows of the others are counted among those of all kinds
    n = F.size("ws").cast("long")
    whole = hot.join(kinds.where("c > 1").select("anchor", "w"), ["anchor", "w"]).select("_h", "_g", "at", F.transform("at", lambda x: n).alias("n"))
    counted = kinds.select("anchor", "c", F.explode("ws").alias("x")).groupBy("anchor", "x").agg(F.sum("c").alias("c")).where("c > 1").select("anchor", "x")
    single = kinds.where("c = 1").select("anchor", "_h", "_g", F.col("at")[0].alias("first"), F.posexplode("ws").alias("i", "x")).select("anchor", "_h", "_g", (F.col("first") + F.col("i")).alias("at"), "x")
    ones = single.join(counted, ["anchor", "x"]).select("_h", "_g", F.array("at").alias("at"), F.array(F.lit(1).cast("long")).alias("n"))
    spans = spans.select("_h", "_g", F.array("at").alias("at"), F.array("n").alias("n")).union(whole).union(ones)
    by_text = spans.groupBy("_h", "_g").agg(F.flatten(F.collect_list("at")).alias("starts"), F.flatten(F.collect_list("n")).alias("counts"))
    return texts.select("_h", "_g", "copies").join(by_text, ["_h", "_g"], "left").where("copies > 1 or starts is not null")


def keep_mask(n: int, copies: int | None, starts: list[int] | None, counts: list[int] | None, window: int) -> np.ndarray | None:
    """Which of n words stay; None: all."""
    if copies is not None and copies > 1 and n >= window:
        return np.zeros(n, bool)
    if not starts:
        return None
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.add(starts, counts) + window - 1, -1)
    return np.cumsum(edge[:-1]) == 0


def remove_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", rewrite: bool = False) -> DataFrame:
    """id, n_words, n_removed, kept_sha256; with rewrite=True the columns of docs, the text without the removed words.

    A null text has no words (rewrite leaves it null); texts shorter than the window lose nothing; all places of a repeated
    window are judged on the input, so the first is removed like the others. Repeated rows are repeats. Null ids
    are rows like any other; an empty table gives no rows. A rewritten text joins its kept words by one space; a text
    that loses nothing stays as it is.
    """
    small_batches(docs.sparkSession)
    own = docs if rewrite else docs.select(id_col, text_col)
    names, kinds = own.columns, types_of(own)
    with scope() as keep:
        marks = keep(written(repeated_spans(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), window), "marks"))
    marks = marks.toDF(*[free_name(c, names) for c in marks.columns])
    h, g, *found = marks.columns
    joined = own.withColumns(dict(zip((h, g), text_keys(text_col), strict=True))).join(marks, [h, g], "left").select(*names, *found)
    at = names.index(text_col)
    kept = names if rewrite else [id_col]
    columns = {c: kinds[c] for c in kept} | ({} if rewrite else {"n_words": "long", "n_removed": "long", "kept_sha256": "string"})

    def build():
        def batch(b: pa.RecordBatch):
            out = {c: b.column(names.index(c)) for c in kept}
            made = {"n_words": [], "n_removed": [], "kept_sha256": []}
            texts = b.column(at).to_pylist()
            for i, (copies, starts, counts) in enumerate(zip(*(b.column(len(names) + j).to_pylist() for j in range(3)), strict=True)):
                words = words_of(texts[i])
                mask = keep_mask(len(words), copies, starts, counts, window)
                stay = words if mask is None else [words[j] for j in np.flatnonzero(mask)]
                if rewrite:
                    texts[i] = texts[i] if mask is None else b" ".join(stay).decode()
                else:
                    for c, v in zip(made, (len(words), len(words) - len(stay), hashlib.sha256(b" ".join(stay)).hexdigest()), strict=True):
                        made[c].append(v)
            return out | ({text_col: texts} if rewrite else made)

        return batch

    return map_rows(joined, columns, build)
