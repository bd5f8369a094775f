"""Spans of many names in one pass over each text: an Aho-Corasick automaton over tokens of folded text.

A token is a word (letters and digits, Han apart) or any other single character, so a name's tokens match where the name stands as
whole words, and a Han name anywhere. Case, diacritics and width are folded character by character, and places map back to the text.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import accumulate, repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.folding import fold_key

_TOKEN = re.compile(r"[^\W_㐀-鿿]+|.", re.S)
#: Bytes of names that are sent to the tasks at once; more are searched for in turns.
SENT = 8 << 20
#: Bytes of an Arrow batch of whole texts.
BATCH_BYTES = "4194304"


class _Folded(dict):
    """For str.translate: a character's folded form."""

    def __missing__(self, c: int) -> str:
        self[c] = "".join(x for x in unicodedata.normalize("NFKD", chr(c)).casefold() if not unicodedata.combining(x))
        return self[c]


class _Lengths(dict):
    """For str.translate: the length of a character's folded form, as a character."""

    def __missing__(self, c: int) -> str:
        self[c] = chr(len(_folded[c]))
        return self[c]


_folded, _lengths = _Folded(), _Lengths()


def _bordered(name: str) -> bool:
    """Can the name overlap itself?"""
    return any(name.startswith(name[k:]) for k in range(1, len(name)))


class Names:
    """An automaton of folded names."""

    def __init__(self, names: list[str]):
        self.ids: dict[str, int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for name in names:
            tokens = _TOKEN.findall(name)
            if tokens:
                self.automaton.add_word(tuple(self.ids.setdefault(t, len(self.ids) + 1) for t in tokens), (name, len(tokens), _bordered(name)))
        if self.ids:
            self.automaton.make_automaton()

    def spans(self, text: str) -> Iterator[tuple[str, int, int, str]]:
        """(name, UTF-8 start, UTF-8 length, original spelling) of each whole occurrence; occurrences of one name do not overlap."""
        if not self.ids or not text:
            return
        plain = text.isascii()
        folded = text.lower() if plain else text.translate(_folded)
        tokens = _TOKEN.findall(folded)
        ends = back = places = None
        done: set[str] = set()
        for last, (name, n, bordered) in self.automaton.iter(tuple(map(self.ids.get, tokens, repeat(0)))):
            if ends is None:
                ends = [0, *accumulate(map(len, tokens))]
                if not plain:
                    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
                    places = np.concatenate([[0], np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000))])
                    lengths = np.frombuffer(text.translate(_lengths).encode("utf-32-le"), "<u4")
                    back = np.append(np.repeat(np.arange(len(text)), lengths), len(text))
            if not bordered:
                found = [(ends[last + 1 - n], ends[last + 1])]
            elif name in done:
                continue
            else:
                done.add(name)
                found = list(_in_turn(folded, name))
            for lo, hi in found:
                if plain:
                    yield name, lo, hi - lo, text[lo:hi]
                else:
                    lo, hi = int(back[lo]), int(back[hi])
                    yield name, int(places[lo]), int(places[hi] - places[lo]), text[lo:hi]


def _word(c: str) -> bool:
    return c.isalnum() and not "㐀" <= c <= "鿿"


def _in_turn(folded: str, name: str) -> Iterator[tuple[int, int]]:
    """Places of a name, each looked for behind the one before it, whether that was a whole one or not."""
    at = 0
    while (at := folded.find(name, at)) >= 0:
        end = at + len(name)
        if not (at and _word(folded[at - 1]) and _word(name[0])) and not (end < len(folded) and _word(folded[end]) and _word(name[-1])):
            yield at, end
        at = end


def _small_batches(spark: SparkSession) -> None:
    """Bounds the bytes of an Arrow batch for good, as Spark reads the setting when a plan runs; a smaller bound is kept."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, str((1 << 31) - 2)).rstrip("bB")) > int(BATCH_BYTES):
        spark.conf.set(key, BATCH_BYTES)


def name_spans(texts: DataFrame, names: DataFrame, id_col: str, text_col: str, name_col: str, sent: int = SENT) -> DataFrame:
    """id, alias, utf8_start, utf8_length, mentioned_text: every whole span of every name in every text.

    alias is the folded name; names with the same folded form, repeated ones and blank or null ones are one or none. Null texts have no spans;
    repeated rows give rows each. Names go to the tasks as an automaton, in as many turns as their bytes ask for.
    """
    _small_batches(texts.sparkSession)
    folded = names.select(fold_key(name_col).alias("n")).where("n <> ''").distinct()
    size = folded.agg(F.coalesce(F.sum(F.octet_length("n")), F.lit(0))).first()[0]
    turns = size // sent + 1
    kind = texts.schema[id_col].dataType
    schema = f"{id_col} {kind.simpleString()}, alias string, utf8_start long, utf8_length long, mentioned_text string"
    out = None
    for i in range(turns):
        own = folded.where(F.pmod(F.xxhash64("n"), F.lit(turns)) == i) if turns > 1 else folded
        found = texts.select(id_col, text_col).mapInArrow(_finder([r[0] for r in own.toLocalIterator()]), schema)
        out = found if out is None else out.unionByName(found)
    return out


_WORD = re.compile(r"[^\W_]+")


def word_places(texts: DataFrame, words: DataFrame, id_col: str, text_col: str, word_col: str, sent: int = SENT) -> DataFrame:
    """id, alias, utf8_start, utf8_length: the first place of each word (lower case, letters and digits) in each text, in one pass over the text.

    Words go to the tasks as a set, in as many turns as their bytes ask for. Null texts have none; repeated rows give rows each.
    """
    _small_batches(texts.sparkSession)
    own = words.where(F.col(word_col).isNotNull()).select(F.col(word_col).alias("w")).distinct()
    size = own.agg(F.coalesce(F.sum(F.octet_length("w")), F.lit(0))).first()[0]
    turns = size // sent + 1
    schema = f"{id_col} {texts.schema[id_col].dataType.simpleString()}, alias string, utf8_start long, utf8_length long"
    out = None
    for i in range(turns):
        some = own.where(F.pmod(F.xxhash64("w"), F.lit(turns)) == i) if turns > 1 else own
        found = texts.select(id_col, text_col).mapInArrow(_first_places({r[0] for r in some.toLocalIterator()}), schema)
        out = found if out is None else out.unionByName(found)
    return out


def _first_places(wanted: set[str]):
    def run(batches):
        for batch in batches:
            rows, own = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                seen, at, size = set(), 0, 0
                for m in _WORD.finditer(text or ""):
                    word = m[0].lower()
                    if word in wanted and word not in seen:
                        seen.add(word)
                        size, at = size + len(text[at : m.start()].encode()), m.start()
                        rows.append(i)
                        own.append((word, size, len(m[0].encode())))
            kinds = (pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array([x[k] for x in own], t) for k, t in enumerate(kinds))], names=[batch.schema.names[0], "alias", "utf8_start", "utf8_length"])

    return run


def _finder(names: list[str]):
    def run(batches):
        automaton = Names(names)
        for batch in batches:
            ids = batch.column(0)
            rows, own = [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                if text:
                    for x in automaton.spans(text):
                        rows.append(i)
                        own.append(x)
                if len(rows) > 50_000:
                    yield _made(batch.schema.names[0], ids, rows, own)
                    rows, own = [], []
            yield _made(batch.schema.names[0], ids, rows, own)

    return run


def _made(name: str, ids: pa.Array, rows: list[int], own: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
    columns = [ids.take(pa.array(rows, pa.int64())), *(pa.array([x[k] for x in own], t) for k, t in enumerate(kinds))]
    return pa.RecordBatch.from_arrays(columns, names=[name, "alias", "utf8_start", "utf8_length", "mentioned_text"])

