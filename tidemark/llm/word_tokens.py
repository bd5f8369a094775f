"""Exact token ids of the word-level BPE tokenizer, word by word through bounded caches.

The tokenizer drops white space and never merges across it, so a text's ids are its space-separated chunks' ids in
a row. Chunks of plain Latin text are cut by the tokenizer's own pre-token pattern and each pre-token goes to its BPE
model; every other chunk goes to the whole tokenizer. Either way each chunk is encoded once while it stays cached.
"""

from __future__ import annotations

import re

import numpy as np

from tidemark.llm.shared import kept

#: All but characters that neither normalization form C nor context changes and that both libraries class alike.
_ODD = re.compile("[^\t\n\x20-\x7eÀ-ÖØ-öø-ÿ]|<\\|")
_PRE_TOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
#: Fixed by the byte-level scheme: printable bytes stand for themselves, the rest for 256 and up.
_KEPT = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARS = {b: chr(b) for b in _KEPT} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _KEPT)}
MAX_CHUNKS, MAX_WORDS, MAX_CACHED_CHARS = 300_000, 500_000, 64


class WordTokens(dict):
    """chunk -> little-endian unsigned 32-bit ids as bytes. Caches start anew when full, so memory is bounded."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model, self.words = self.whole.model, {}

    def _whole(self, chunk: str) -> bytes:
        return np.array(self.whole.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        mapped = word if word.isascii() and word.isalnum() else "".join(map(_BYTE_CHARS.__getitem__, word.encode()))
        ids = np.array([t.id for t in self.model.tokenize(mapped)], "<u4").tobytes()
        if len(word) <= MAX_CACHED_CHARS:
            if len(self.words) >= MAX_WORDS:
                self.words.clear()
            self.words[word] = ids
        return ids

    def __missing__(self, chunk: str) -> bytes:
        if _ODD.search(chunk):
            ids = self._whole(chunk)
        else:
            known = self.words
            ids = b"".join([known[w] if w in known else self._word(w) for w in _PRE_TOKEN.findall(chunk.lower())])
        if len(chunk) <= MAX_CACHED_CHARS:
            if len(self) >= MAX_CHUNKS:
                self.clear()
            self[chunk] = ids
        return ids

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not _ODD.search(text):
            text = text.lower().replace("\n", " ").replace("\t", " ")
        return b"".join(map(self.__getitem__, text.split(" ")))


def word_tokens(path: str) -> WordTokens:
    """One for each worker process; tasks of the same worker share its caches, until one of another operator comes."""
    return kept(path, lambda: WordTokens(path))
