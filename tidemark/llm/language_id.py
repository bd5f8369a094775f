"""Language identification by words first, with back-off to character n-grams.

A known word adds its log frequency in each language. A word never seen in training falls back to its longest known
character n-grams: the mean log frequency of those of length 5, else 4, and so on down to 1. The language with the largest
sum wins; its score is its share of the likelihood at equal priors.

The model is fitted on a bounded sample: at most `sample_docs` labelled documents of each language (those of the smallest
id hash), a documented parameter. It learns every word and n-gram of the sample, so its size is bounded by the sample
whatever the corpus; prediction runs over all documents.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tidemark.llm.shared import free_name, map_rows, small_batches, types_of
from tidemark.plans.scratch import drop, written

#: A word is a run of letters; a longer one (a clause, in scripts without spaces) is cut into words of 48 letters. The same for the JVM, where texts
#: are learnt from.
JVM_WORD = r"\p{L}{1,48}"
#: As JVM_WORD finds them, but for numbers like a half that are no letters and stand in a word.
_WORD = re.compile(r"[^\W\d_]{1,48}")
GRAM_SIZES, SMOOTH, MAX_CACHED, MAX_SCORES = (5, 4, 3, 2, 1), 0.5, 200_000, 8_000_000
UNKNOWN = "und"


class Model:
    """languages; 64-bit hashes of the known words (size 0) and n-grams, ascending; their counts, of the languages that have them only.

    Key r - 1 is row r; row 0 is for what is not known at all. A key's log frequency in a language is that of a count of none for its size, and
    more where it was counted. Arrays, not names: every Python worker holds a model.
    """

    def __init__(self, languages: list[str], keys: np.ndarray, sizes: np.ndarray, starts: np.ndarray, of: np.ndarray, counts: np.ndarray):
        """sizes: each key's size. of, counts: language numbers and counts, those of a key from its start up to the next one's."""
        self.languages = languages
        totals, kinds = np.zeros((max(GRAM_SIZES) + 1, len(languages))), np.bincount(sizes, minlength=max(GRAM_SIZES) + 1)
        n = np.diff(np.append(starts, len(of)))
        np.add.at(totals, (np.repeat(sizes, n), of), counts)
        #: log frequency of a count of none, by size and language.
        self.none = np.log(SMOOTH / (totals + SMOOTH * np.maximum(kinds, 1)[:, None]))
        order = np.argsort(keys)
        self.keys, self.sizes = keys[order], np.append(0, sizes[order]).astype(np.int8)
        self.ends = np.cumsum(np.append(0, n[order]))
        at = np.repeat(starts[order] - self.ends[:-1], n[order]) + np.arange(len(of))
        self.of, self.more = of[at].astype(np.int32), np.log((counts[at] + SMOOTH) / SMOOTH).astype(np.float32)

    @classmethod
    def counted(cls, languages: list[str], by_size: dict[int, dict[str, list[int]]]) -> Model:
        """From counts by language of each word (size 0) or n-gram."""
        rows = [(size, name, row) for size, own in by_size.items() for name, row in own.items()]
        keys = np.array([cls.hashes(size, [name])[0] for size, name, _ in rows], np.uint64)
        full = np.array([row for _, _, row in rows], np.int64).reshape(len(rows), len(languages))
        at, of = np.nonzero(full)
        starts = np.searchsorted(at, np.arange(len(rows)))
        return cls(languages, keys, np.array([size for size, _, _ in rows], np.int64), starts, of, full[at, of])

    def logs(self, rows: np.ndarray) -> np.ndarray:
        """Log frequencies by language of each row."""
        out = np.where((rows > 0)[:, None], self.none[self.sizes[rows]], 0.0)
        n = np.where(rows > 0, self.ends[rows] - self.ends[np.maximum(rows - 1, 0)], 0)
        at = np.repeat(self.ends[np.maximum(rows - 1, 0)] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        out[np.repeat(np.arange(len(rows)), n), self.of[at]] += self.more[at]
        return out

    @staticmethod
    def hashes(size: int, names) -> np.ndarray:
        """Of words (size 0) or n-grams."""
        import xxhash

        return np.fromiter((xxhash.xxh64_intdigest(x, size) for x in names), np.uint64)

    def find(self, size: int, names) -> np.ndarray:
        """Row of each word (size 0) or n-gram; 0 for what is not known."""
        own = self.hashes(size, names)
        if not len(self.keys):
            return np.zeros(len(own), np.int64)
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        return np.where(self.keys[at] == own, at + 1, 0)

    def rows(self, words: list[str]) -> list[np.ndarray]:
        """For each word, rows whose mean scores it: its own, else those of its longest known n-grams, else row 0."""
        out = list(self.find(0, words)[:, None])
        rest = [i for i, r in enumerate(out) if not r[0]]
        for n in GRAM_SIZES:
            grams = [[w[i : i + n] for i in range(len(w) - n + 1)] for w in (f"<{words[i]}>" for i in rest)]
            found = self.find(n, (g for own in grams for g in own))
            open_ = []
            for i, own in zip(rest, np.split(found, np.cumsum([len(g) for g in grams])[:-1]) if rest else [], strict=True):
                if own.any():
                    out[i] = own[own > 0]
                else:
                    open_.append(i)
            rest = open_
        return out

    def scores(self, words: list[str]) -> np.ndarray:
        """A row of scores by language for each word."""
        found = self.rows(words)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.add.reduceat(self.logs(np.concatenate(found)), np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]


def fit(docs: DataFrame, sample_docs: int = 1000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts the words of the sample and their n-grams by language.

    Rows whose id, text or lang is null teach nothing; rows that share an id are sampled together. No labelled rows: a
    model without languages.
    """
    known = docs.select(F.col(id_col).alias("i"), F.col(lang_col).alias("l")).where("i is not null and l is not null")
    least = known.withColumn("h", F.xxhash64(F.col("i").cast("string"))).withColumn("slot", F.pmod("h", F.lit(64)))
    # two steps, so that a language with a third of all rows is not ranked in one task
    first = least.withColumn("r", F.row_number().over(Window.partitionBy("l", "slot").orderBy("h", "i"))).where(F.col("r") <= sample_docs)
    ids = first.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("h", "i"))).where(F.col("r") <= sample_docs)
    chosen = ids.select(F.col("i").alias("_i")).distinct().toArrow()  # at most sample_docs a language
    if not len(chosen):
        return Model.counted([], {})
    kind = StructType([StructField("_i", types_of(docs)[id_col])])
    # back through Arrow, as from a list Python workers of another kind would start in the executors, and stay
    sample = docs.join(F.broadcast(docs.sparkSession.createDataFrame(chosen, kind)), F.col(id_col) == F.col("_i"), "left_semi")
    words = sample.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("l"), F.explode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(JVM_WORD), F.lit(0))).alias("w"))
    counted = written(words.groupBy("l", "w").agg(F.count("*").alias("n")), "words")
    marked = F.concat(F.lit("<"), F.col("w"), F.lit(">"))
    size = F.explode(F.array(*[F.lit(n) for n in GRAM_SIZES])).alias("size")
    starts = F.when(F.length("m") >= F.col("size"), F.sequence(F.lit(1), F.length("m") - F.col("size") + 1))
    pieces = counted.select("l", "n", marked.alias("m"), size).select("l", "n", "size", F.explode(F.transform(starts, lambda i: F.substring(F.col("m"), i, F.col("size")))).alias("w"))
    by_gram = pieces.groupBy("l", "size", "w").agg(F.sum("n").alias("n"))
    # all of the sample, which is bounded
    found = counted.select("l", F.lit(0).alias("size"), "w", "n").unionByName(by_gram).orderBy("size", "w", "l").toArrow().combine_chunks()
    drop(counted)
    names = found.column("l").combine_chunks().dictionary_encode()
    languages = sorted(names.dictionary.to_pylist())
    of = np.array([languages.index(x) for x in names.dictionary.to_pylist()], np.int64)[names.indices.to_numpy()]
    size = found.column("size").to_numpy().astype(np.int64)
    keys = np.concatenate([np.empty(0, np.uint64), *(Model.hashes(n, found.column("w").filter(pa.array(size == n)).to_pylist()) for n in sorted({*size.tolist()}))])
    starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (size[1:] != size[:-1]))) if len(keys) else np.empty(0, np.int64)
    return Model(languages, keys[starts], size[starts], starts, of, found.column("n").to_numpy())


def words_of(text: str) -> list[str]:
    """The words of a lower-cased text."""
    found = _WORD.findall(text)
    if not all(map(str.isalpha, found)):
        found = _WORD.findall("".join(c if c.isalpha() else " " for c in text))
    return found


class _Cache(dict):
    """word -> row of a growing matrix of scores; both start anew when full."""

    def __init__(self, model: Model):
        self.room = max(1 << 16, min(MAX_CACHED, MAX_SCORES // max(1, len(model.languages))))
        self.model, self.scores = model, np.zeros((self.room, len(model.languages)))

    def total(self, words: list[str]) -> np.ndarray:
        """The words' scores summed up."""
        out = np.zeros(self.scores.shape[1])
        for at in range(0, len(words), 1 << 15):
            some = words[at : at + (1 << 15)]
            fresh = [w for w in set(some) if w not in self]
            if len(self) + len(fresh) > self.room:
                self.clear()
                fresh = list(set(some))
            if fresh:
                first = len(self)
                self.scores[first : first + len(fresh)] = self.model.scores(fresh)
                self.update(zip(fresh, range(first, first + len(fresh)), strict=True))
            out += self.scores[np.fromiter(map(self.__getitem__, some), np.int64, len(some))].sum(axis=0)
        return out


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """id, lang_pred, score for each row; with carry=True all columns of docs, then lang_pred and score (with underscores
    added to their names where docs has columns of these names).

    lang_pred is `und` with score 0 for a null text, one without a letter, and for every text if the model knows no language.
    Equal likelihoods go to the first language by code point. Long texts are read whole; repeated and null ids are
    rows like any other; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    broadcast = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample that it was fitted on

    def judge(cache: _Cache, text: str | None) -> tuple[str, float]:
        words = words_of(text.lower()) if text else []
        languages = cache.model.languages
        if not languages or not words:
            return UNKNOWN, 0.0
        total = cache.total(words)
        best = int(np.argmax(total))
        return languages[best], 1 / sum(math.exp(max(-700, x - total[best])) for x in total)

    own = docs if carry else docs.select(id_col, text_col)
    names = own.columns
    at = names.index(text_col)
    kept = names if carry else [id_col]
    said, sure = free_name("lang_pred", kept), free_name("score", kept)

    def build():
        cache = _Cache(broadcast.value)

        def batch(b: pa.RecordBatch):
            got = [judge(cache, t) for t in b.column(at).to_pylist()]
            return {c: b.column(names.index(c)) for c in kept} | {said: [x[0] for x in got], sure: [x[1] for x in got]}

        return batch

    kinds = types_of(own)
    return map_rows(own, {c: kinds[c] for c in kept} | {said: "string", sure: "double"}, build)
