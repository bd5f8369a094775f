"""Token counts by the whole-token shortcut, for a sentence-piece BPE model.

Offline, on the driver, `prove()` reads the vocabulary and shows (1) that no piece holds the space mark after another
character, so no merge crosses from a word to the space mark that follows it and a text's tokens are its
segments' tokens in a row (a segment: a run of spaces and the characters up to the next space); and (2) which
vocabulary strings encode alone as one token. A segment among these counts 1 without any merging; only the
rest are merged by the library, once each while they stay in a bounded cache.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.shared import map_rows, small_batches, types_of

MARK = "▁"
_SEGMENT = re.compile(" +[^ ]*")
MAX_CACHED, MAX_CACHED_CHARS = 400_000, 64


def load(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def prove(path: str) -> list[str]:
    """Vocabulary strings that follow one space mark and encode alone as one token.

    Raises ValueError if a piece holds the mark after another character: counts of segments would not add up then.
    """
    model = load(path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
        raise ValueError(f"{path}: a piece crosses the start of a word")
    whole = [p[1:] for p in pieces if p.startswith(MARK) and len(p) > 1 and MARK not in p[1:]]
    return [p for p, ids in zip(whole, model.encode(whole), strict=True) if len(ids) == 1]


class SegmentCounts(dict):
    """segment without its last space mark -> number of tokens; proven strings stay, others come and go."""

    def __init__(self, path: str, proven: list[str]):
        self.model, self.proven = load(path), dict.fromkeys(proven, 1)
        self.update(self.proven)

    def __missing__(self, segment: str) -> int:
        n = len(self.model.encode(segment)) if segment else 1
        if len(segment) <= MAX_CACHED_CHARS:
            if len(self) >= MAX_CACHED:
                self.clear()
                self.update(self.proven)
            self[segment] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if MARK in text or "\0" in text:
            return len(self.model.encode(text))
        if text[0] != " " and text[-1] != " " and "  " not in text:
            return sum(map(self.__getitem__, text.split(" ")))
        return sum(self[s[1:]] for s in _SEGMENT.findall(f" {text}"))


_loaded: dict[str, SegmentCounts] = {}


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes long (UTF-8), n_tokens long, over_limit boolean (n_tokens > limit), a row for each row.

    A null text counts as empty (0 bytes, 0 tokens). A null id is kept as null; repeated rows are each
    counted; an empty table gives an empty result. Texts of any length are counted whole. Map-only: no shuffle. Other
    columns are not read, whatever their names.
    """
    small_batches(docs.sparkSession)
    proven = prove(model_path)

    def build():
        if model_path not in _loaded:
            _loaded[model_path] = SegmentCounts(model_path, proven)
        counts = _loaded[model_path]

        def batch(b: pa.RecordBatch):
            texts = b.column(1).to_pylist()
            n = [counts.count(t) for t in texts]
            return {id_col: b.column(0), "n_bytes": [len(t.encode()) if t else 0 for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

        return batch

    kind = types_of(docs)[id_col]
    return map_rows(docs.select(id_col, text_col), {id_col: kind, "n_bytes": "long", "n_tokens": "long", "over_limit": "boolean"}, build)
