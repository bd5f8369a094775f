"""Text functions as SQL text for both engines."""

from __future__ import annotations

from tidemark.plans.dialect import Dialect

#: Splits at punctuation and white space.
BREAKS = r"[\p{P}\p{Z}\t\n\r\f]+"
#: Han scalars that both dedup and clustering append one by one.
HAN = r"[\x{3400}-\x{9FFF}]"
#: The blocks that search takes for Han.
HAN_RUN = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2FA1F}]+"
TRACKED_MARKS = ("#",)


def tokens_dedup(d: Dialect, x: str) -> str:
    """Lower-case words of two characters or more, then each Han character."""
    words = d.filter(d.split(f"lower({x})", BREAKS), "w", "length(w) > 1")
    return d.concat(words, d.find_all(f"lower({x})", HAN))


def tokens_cluster(d: Dialect, x: str) -> str:
    """Lower-case words of any length and each Han character, as a sorted set."""
    words = d.filter(d.split(f"lower({x})", BREAKS), "w", "w <> ''")
    return d.distinct(d.concat(words, d.find_all(f"lower({x})", HAN)))


def shingles(d: Dialect, tokens: str, n: int = 3) -> str:
    """Runs of n tokens joined by a space; of fewer tokens, the tokens themselves."""
    size = d.size(tokens)
    run = " || ' ' || ".join(d.at(tokens, f"i + {k}" if k else "i") for k in range(n))
    return f"CASE WHEN {size} < {n} THEN {tokens} ELSE {d.windows(tokens, n, run)} END"


def char_grams(d: Dialect, x: str, n: int) -> str:
    """Runs of n characters of the whole text; none of a shorter one."""
    none = "array()" if d.spark else "[]"
    top = f"CAST(length({x}) AS INT) - {n - 1}"
    each = d.map(f"sequence(1, {top})" if d.spark else f"range(1, {top} + 1)", "i", f"substr({x}, {'i' if d.spark else 'CAST(i AS BIGINT)'}, {n})")
    return f"CASE WHEN length({x}) < {n} THEN CAST({none} AS {'ARRAY<STRING>' if d.spark else 'VARCHAR[]'}) ELSE {each} END"


def name_uuid(d: Dialect, x: str) -> str:
    """A name-based identifier: the first 16 bytes of SHA-256 with version nibble 5 and the usual variant bits."""
    h = d.sha256(x)
    # the variant's hex digit, from the low two bits of the 17th one
    variant = f"substr('89ab', (strpos('0123456789abcdef', substr({h}, 17, 1)) - 1) % 4 + 1, 1)"
    if d.spark:
        variant = variant.replace("strpos(", "instr(")
    return f"concat(substr({h}, 1, 8), '-', substr({h}, 9, 4), '-5', substr({h}, 14, 3), '-', {variant}, substr({h}, 18, 3), '-', substr({h}, 21, 12))"


def language_family(d: Dialect, code: str) -> str:
    return f"coalesce(split_part(lower({code}), '-', 1), 'unknown')"


def sentences(d: Dialect, x: str) -> str:
    """Trimmed parts between sentence ends and newlines."""
    return d.map(d.split(x, r"[.!?。！？\n]+"), "s", "trim(s)")


def escape_xml(d: Dialect, x: str) -> str:
    out = x
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = f"replace({out}, '{a}', '{b}')"
    return out


def clamp01(x: str) -> str:
    return f"greatest(0.0, least(1.0, {x}))"


def normal_name(d: Dialect, x: str) -> str:
    """Lower case, white space collapsed and trimmed (accents: see functions.folding)."""
    return f"trim({d.replace_all(f'lower({x})', r'\s+', chr(39) + ' ' + chr(39))})"
