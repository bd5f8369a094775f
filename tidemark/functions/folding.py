"""Unicode forms that the JVM's functions lack, as Arrow-batched functions over whole columns."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@F.pandas_udf(StringType())
def nfkc_lower(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t).lower(), na_action="ignore")


def fold(text: str) -> str:
    """Case, diacritics and width folded; white space collapsed and trimmed."""
    spread = unicodedata.normalize("NFKD", text).casefold()
    return " ".join("".join(c for c in spread if not unicodedata.combining(c)).split())


@F.pandas_udf(StringType())
def fold_key(texts: pd.Series) -> pd.Series:
    return texts.map(fold, na_action="ignore")


@F.pandas_udf(StringType())
def author_key(names: pd.Series) -> pd.Series:
    """Case and diacritics folded, trimmed; nothing for a blank name."""

    def key(name: str) -> str | None:
        bare = "".join(c for c in unicodedata.normalize("NFD", name) if not unicodedata.combining(c))
        return unicodedata.normalize("NFC", bare).lower().strip() or None

    return names.map(key, na_action="ignore")


def alias_spans(text: str, alias: str) -> list[tuple[int, int, str]]:
    """(UTF-8 start, UTF-8 length, original spelling) of each whole occurrence, case, diacritics and width folded.

    Characters are folded one by one, so places in the folded text map back; a Latin neighbour forbids a match at a word's
    edge, a Han one does not.
    """
    wanted = fold(alias)
    if not wanted:
        return []
    folded, back = [], []
    for i, c in enumerate(text):
        for x in unicodedata.normalize("NFKD", c).casefold():
            if not unicodedata.combining(x):
                folded.append(x)
                back.append(i)
    whole, out, at = "".join(folded), [], 0
    word = lambda c: c.isalnum() and not "㐀" <= c <= "鿿"
    while (at := whole.find(wanted, at)) >= 0:
        end = at + len(wanted)
        before, after = whole[at - 1 : at], whole[end : end + 1]
        if not (before and word(before) and word(wanted[0])) and not (after and word(after) and word(wanted[-1])):
            lo = back[at]
            hi = back[end] if end < len(back) else len(text)
            out.append((len(text[:lo].encode()), len(text[lo:hi].encode()), text[lo:hi]))
        at = end
    return out


class _Marks:
    """Places of marks in a text, looked up forwards; none is searched for again from where it was missing."""

    def __init__(self, text: str):
        self.text, self.found = text, {}

    def next(self, mark: str, at: int) -> int:
        known = self.found.get(mark)
        if known is None or 0 <= known < at:
            known = self.found[mark] = self.text.find(mark, at)
        return known

    def escaped(self, at: int) -> bool:
        """Is there an odd number of backslashes before?"""
        first = at
        while first and self.text[first - 1] == "\\":
            first -= 1
        return (at - first) % 2 == 1


def _formula(marks: _Marks, at: int) -> tuple[str, int, int, int] | None:
    """(kind, first and end of the content, end of the formula) of a formula that opens here, if one does."""
    text = marks.text
    opening = next((o for o in ("\\(", "\\[", "$$", "$") if text.startswith(o, at)), None)
    if opening is None or marks.escaped(at):
        return None
    closing = {"\\(": "\\)", "\\[": "\\]"}.get(opening, opening)
    first = at + len(opening)
    end = marks.next(closing, first)
    if end < 0 or text[first:end].isspace() or first == end:
        return None
    if opening == "$" and (text[first].isspace() or text[end - 1].isspace() or marks.escaped(end)):
        return None
    return ("display" if opening in ("\\[", "$$") else "inline"), first, end, end + len(closing)


def math_pieces(text: str) -> list[tuple[str, str]]:
    r"""(kind, content) pieces: text, inline \( \) or $ $, display \[ \] or $$ $$; a backslash before an opening mark, itself not escaped, makes it text.

    Content is never blank, and between single dollars it neither begins nor ends with white space; a formula ends at the first closing mark.
    """
    out, plain, marks = [], 0, _Marks(text)
    openings = re.compile(r"\\[(\[]|\$")
    at = 0
    while m := openings.search(text, at):
        at = m.start()
        found = _formula(marks, at)
        if found is None:
            at += 1
            continue
        kind, first, end, after = found
        if plain < at:
            out.append(("text", text[plain:at]))
        out.append((kind, text[first:end]))
        plain = at = after
    return [*out, ("text", text[plain:])] if plain < len(text) else out


class MathPieces:
    """For spark.udtf: a row (place, kind, content) for each piece of a text."""

    def eval(self, text: str):
        yield from ((i, kind, content) for i, (kind, content) in enumerate(math_pieces(text or "")))
