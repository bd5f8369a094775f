"""Personal data by weak supervision.

Every text gives candidate spans: the exact forms (base), and looser ones around them (addresses written with words, IPv6 and
defanged addresses, numbers in other groupings). Five labelers vote on each candidate, for, against or not at all: the exact form,
the format (checksums, ranges, valid addresses), gazetteers (domains, calling codes, issuers, reserved addresses), the words around it,
and its borders. The corpus is reduced to counts of (kind, votes and features); expectation-maximisation over these counts estimates
how reliable each labeler is for each kind and how likely each pattern is personal data; and a logistic classifier of the features,
trained on those likelihoods, decides about the candidates. Base spans stay whatever it says. The texts are read twice and never move.
"""

from __future__ import annotations

import ipaddress
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import map_rows, small_batches, types_of

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("exact", "format", "gazetteer", "context", "border")
#: Features besides the votes.
EXTRA = ("words for signs", "separators", "over 12 digits", "after a colon", "at the start of a line", "a word of another kind near")
SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
#: Patterns of votes and features that EM and the classifier are fitted on at most, the most frequent first.
MAX_PATTERNS = 10_000

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGITS = bytes(b for b in range(256) if not 0x30 <= b <= 0x39)

_AT = (" at ", " AT ", "(at)", "(AT)", "[at]", "[AT]", "{at}", "<at>", " @", "@ ")
_SPOKEN = re.compile(r" ?[A-Za-z0-9-]{1,63}(?:(?:\.| ?(?:\(dot\)|\[dot\]|\{dot\}|\[\.\]) ?| dot )[A-Za-z0-9-]{1,63}){1,5}", re.I)
_DEFANGED = re.compile(r"(?<![0-9])[0-9]{1,3}(?: ?(?:\[\.\]|\(\.\)) ?[0-9]{1,3}){3}(?![0-9])")
_IPV6 = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])")
_LONE = re.compile(r"(?<![0-9])[0-9]{13,19}(?![0-9])")
_FOURS = re.compile("(?<![0-9])[0-9]{4}([ ./_ -])[0-9]{4}\\1[0-9]{4}\\1[0-9]{1,7}(?![0-9])")
_DIALLED = re.compile(r"(?<![0-9A-Za-z+.])(?:00[ .-]?[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ ./-]{1,2}[0-9]{3,4}[ ./-][0-9]{3,4}(?![0-9])")

_TOP = frozenset("com org net edu gov mil int info biz io dev app co me eu uk de fr es it nl be at ch pl se no dk fi ie pt cz gr ru ua jp cn in kr br mx ar ca us au nz za example".split())
_FILES = frozenset("txt py js ts html htm css json xml csv md png jpg jpeg gif svg pdf zip gz tar exe dll java cpp log".split())
_CALLING = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 98 212 213 216 351 352 353 358 380 420 421 852 886 971 972".split())
_NEAR = {
    "email": frozenset("mail email e-mail correo courriel mailto contact write reach from to cc bcc an von para kontakt schreiben".split()),
    "ip": frozenset("ip ipv4 ipv6 host server address addr client peer adresse login logged desde depuis".split()),
    "card": frozenset("card visa mastercard amex credit debit payment pay tarjeta carte karte kreditkarte cc pan".split()),
    "phone": frozenset("phone tel telephone call mobile cell fax dial whatsapp sms telefon telefono teléfono móvil handy anruf appelez numéro llame".split()),
}
_AWAY = frozenset("version v ver release isbn issn order invoice sku serial part build id ref page pages chapter section vol total sum date year score hash commit ratio time".split())
_WORD = re.compile(r"[^\W_]+(?:-[^\W_]+)*")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) << (i & 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _octets(parts: list[str]) -> bool:
    return all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in parts)


def _is_card(s: str) -> bool:
    return 13 <= len(d := _digits(s)) <= 19 and luhn(d)


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The exact forms: leftmost matches of each kind that do not overlap, then those that pass their test. In linear time."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done = 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):
            start = m.start()
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                found["email"].append((start, m.end()))
                done = m.end()
    n_digits = len(text.encode().translate(None, _NOT_DIGITS))
    if n_digits >= 4:
        found["ip"] = [m.span() for m in _IP.finditer(text) if _octets(m[0].split("."))]
    if n_digits >= 13:
        found["card"] = [m.span() for m in _CARD.finditer(text) if _is_card(m[0])]
    if n_digits >= 9 and "+" in text:
        found["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return found


def _loose(text: str) -> Iterator[tuple[str, int, int]]:
    """Candidates beyond the exact forms; each pattern looks at a bounded stretch from where it begins."""
    for sign in _AT:
        at = text.find(sign)
        while at >= 0:
            start = at
            while start > max(0, at - 64) and text[start - 1] in _LOCAL:
                start -= 1
            if start == at and sign[0] != " " and at and text[at - 1] == " ":
                start = at - 1
                while start > max(0, at - 65) and text[start - 1] in _LOCAL:
                    start -= 1
                start = at if start == at - 1 else start
            m = _SPOKEN.match(text, at + len(sign)) if start < at else None
            if m:
                yield "email", start, m.end()
            at = text.find(sign, at + 1)
    n_digits = len(text.encode().translate(None, _NOT_DIGITS))
    if ":" in text and text.count(":") >= 2:
        yield from (("ip", *m.span()) for m in _IPV6.finditer(text) if len(m[0]) > 3)
    if n_digits >= 4 and ("[.]" in text or "(.)" in text):
        yield from (("ip", *m.span()) for m in _DEFANGED.finditer(text))
    if n_digits >= 13:
        yield from (("card", *m.span()) for m in _LONE.finditer(text))
        yield from (("card", *m.span()) for m in _FOURS.finditer(text))
    if n_digits >= 8:
        yield from (("phone", *m.span()) for m in _DIALLED.finditer(text))


def _format(kind: str, s: str) -> int:
    if kind == "email":
        last = re.split(r"[.) \]}]", s)[-1]
        return 1 if last.isalpha() and 2 <= len(last) <= 24 else -1
    if kind == "ip" and ":" in s:
        try:
            ipaddress.IPv6Address(s)
            return 1
        except ValueError:
            return -1
    if kind == "ip":
        return 1 if _octets(re.findall("[0-9]+", s)) else -1
    if kind == "card":
        return 1 if _is_card(s) else -1
    return 1 if 9 <= len(_digits(s)) <= 15 else -1 if len(_digits(s)) < 7 else 0


def _gazetteer(kind: str, s: str) -> int:
    d = _digits(s)
    if kind == "email":
        last = re.split(r"[.) \]}]", s)[-1].lower()
        return 1 if last in _TOP else -1 if last in _FILES else 0
    if kind == "ip":
        try:
            x = ipaddress.ip_address(re.sub(r"[^0-9A-Fa-f:.]", "", s))
        except ValueError:
            return 0
        return -1 if x.is_loopback or x.is_unspecified or x.is_multicast and x.version == 6 else 1
    if kind == "card":
        return 1 if d[:1] in ("4", "5", "6") or d[:2] in ("34", "37", "35", "22", "30", "36", "38") else -1
    if s[0] == "+":
        return 1 if any(d[:n] in _CALLING for n in (1, 2, 3)) else -1
    return 1 if d[:2] == "00" and any(d[2 : 2 + n] in _CALLING for n in (1, 2, 3)) else 0


def mask_of(text: str, kind: str, start: int, end: int, exact: bool) -> int:
    """Votes (two bits a labeler: for, against) and further features (a bit each) of a candidate."""
    s, before, after = text[start:end], text[max(0, start - 48) : start], text[end : end + 1]
    words = set(_WORD.findall(before.lower())[-5:])
    context = 1 if words & _NEAR[kind] else -1 if words & _AWAY else 0
    glued = start and (text[start - 1].isalnum() or text[start - 1] == "_") or after and (after.isalnum() or after == "_")
    votes = (int(exact), _format(kind, s), _gazetteer(kind, s), context, -1 if glued else 1)
    extra = (
        "@" not in s and kind == "email", any(c in s for c in " -./()"), len(_digits(s)) > 12, before.rstrip(" ").endswith(":"),
        not before or before[-1] == "\n", any(words & _NEAR[k] for k in KINDS if k != kind),
    )
    out = 0
    for i, v in enumerate(votes):
        out |= (v > 0) << 2 * i | (v < 0) << 2 * i + 1
    for i, x in enumerate(extra):
        out |= bool(x) << 2 * len(votes) + i
    return out


def candidates(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """(kind, start, end, exact): the base spans, then looser ones that overlap none of them."""
    base = base_spans(text)
    taken = sorted(x for own in base.values() for x in own)
    starts = [s for s, _ in taken]
    highest = np.maximum.accumulate([e for _, e in taken]).tolist() if taken else []
    for kind in KINDS:
        yield from ((kind, s, e, True) for s, e in base[kind])
    for kind, s, e in _loose(text):
        i = bisect_left(starts, e)
        if not i or highest[i - 1] <= s:
            yield kind, s, e, False


@dataclass
class Model:
    """Weights of the classifier by kind (bias last), and what EM found: by kind, the share of personal data and each labeler's
    chances of voting against, not at all and for, given junk and given personal data."""

    weights: dict[str, np.ndarray]
    shares: dict[str, float]
    reliabilities: dict[str, np.ndarray]

    def score(self, kind: str, mask: int) -> float:
        w = self.weights.get(kind)
        return 0.0 if w is None else float(1 / (1 + np.exp(-(_bits(np.array([mask])) @ w[:-1] + w[-1])[0])))


def _bits(masks: np.ndarray) -> np.ndarray:
    return (masks[:, None] >> np.arange(2 * len(LABELERS) + len(EXTRA)) & 1).astype(float)


def _votes(masks: np.ndarray) -> np.ndarray:
    """0 against, 1 no vote, 2 for; a column for each labeler."""
    at = 2 * np.arange(len(LABELERS))
    return 1 + (masks[:, None] >> at & 1) - (masks[:, None] >> at + 1 & 1)


def estimate(masks: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, float, np.ndarray]:
    """EM with two classes: each pattern's chance to be personal data, the share of it, and chances[class, labeler, vote].

    Labelers are taken to vote independently of each other within a class, and to be right rather than wrong beforehand (some counts).
    """
    votes = _votes(masks)
    prior = np.array([[6.0, 3.0, 1.0], [1.0, 3.0, 6.0]])[:, None, :].repeat(len(LABELERS), 1)
    chance = (1 + (votes == 2).sum(1)) / (2 + (votes != 1).sum(1))
    for _ in range(rounds):
        share = float((counts @ chance + 1) / (counts.sum() + 2))
        tables = prior.copy()
        for c, weight in enumerate((counts * (1 - chance), counts * chance)):
            for k in range(len(LABELERS)):
                tables[c, k] += np.bincount(votes[:, k], weight, 3)
        tables /= tables.sum(2, keepdims=True)
        logs = np.log(tables)[:, np.arange(len(LABELERS)), votes].sum(2)
        odds = np.log(share / (1 - share)) + logs[1] - logs[0]
        chance = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
    return chance, share, tables


def train(masks: np.ndarray, counts: np.ndarray, chance: np.ndarray, steps: int = 25, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton's method on patterns that count for both classes by their chance; the bias comes last."""
    x = np.column_stack([_bits(masks), np.ones(len(masks))])
    w, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (counts * (chance - p)) - penalty @ w
        step = np.linalg.solve((x * (counts * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + penalty, slope)
        w = w + step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
    return w


def fit(docs: DataFrame, text_col: str = "text", max_patterns: int = MAX_PATTERNS) -> Model:
    """Counts the patterns of every text's candidates, estimates the labelers' reliabilities and trains the classifier.

    Null and empty texts have no candidates; without candidates of a kind, nothing is added of that kind.
    """
    small_batches(docs.sparkSession)

    def build():
        def batch(b: pa.RecordBatch):
            seen = Counter((k, mask_of(t, k, s, e, x)) for t in b.column(0).to_pylist() if t for k, s, e, x in candidates(t))
            return {"kind": [k for k, _ in seen], "mask": [m for _, m in seen], "n": list(seen.values())}

        return batch

    counted = map_rows(docs.select(text_col), {"kind": "string", "mask": "long", "n": "long"}, build).groupBy("kind", "mask").agg(F.sum("n").alias("n"))
    rows = counted.orderBy(F.col("n").desc(), "kind", "mask").limit(max_patterns).collect()
    model = Model({}, {}, {})
    for kind in KINDS:
        own = [(r["mask"], r["n"]) for r in rows if r["kind"] == kind]
        if own:
            masks, counts = np.array([m for m, _ in own]), np.array([n for _, n in own], float)
            chance, model.shares[kind], model.reliabilities[kind] = estimate(masks, counts)
            model.weights[kind] = train(masks, counts, chance)
    return model


def find_spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """id, base and spans (kind, start, end; code points, end exclusive; by kind, then start), a row for each row.

    spans holds base and the candidates that the classifier gives a chance of at least `least`, best first where they overlap (ties: the one that
    starts first, then the longer). Null and empty texts have none; repeated rows and null ids give rows like any other; an empty table gives none.
    Other columns are not read, whatever their names. Map-only.
    """
    small_batches(docs.sparkSession)

    def build():
        scores: dict[tuple[str, int], float] = {}

        def spans(text: str | None) -> tuple[list, list]:
            base, more = [], []
            for kind, s, e, exact in candidates(text) if text else ():
                if exact:
                    base.append((KINDS.index(kind), s, e))
                    continue
                own = kind, mask_of(text, kind, s, e, False)
                if own not in scores:
                    scores[own] = model.score(*own)
                if scores[own] >= least:
                    more.append((-scores[own], s, -e, KINDS.index(kind)))
            held: list[tuple[int, int, int]] = []
            ends: list[int] = []
            for _, s, e, kind in sorted(more):
                i = bisect_right(ends, s)
                if i == len(ends) or held[i][0] >= -e:
                    held.insert(i, (s, -e, kind))
                    ends.insert(i, -e)
            return base, sorted(base + [(k, s, e) for s, e, k in held])

        named = lambda own: [{"kind": KINDS[k], "start": s, "end": e} for k, s, e in own]

        def batch(b: pa.RecordBatch):
            found = [spans(t) for t in b.column(1).to_pylist()]
            return {id_col: b.column(0), "base": [named(x) for x, _ in found], "spans": [named(x) for _, x in found]}

        return batch

    kind = types_of(docs)[id_col]
    return map_rows(docs.select(id_col, text_col), {id_col: kind, "base": SPANS, "spans": SPANS}, build)
