"""Queries over raw pages, and sequential folds, that SQL does not express."""

from __future__ import annotations

import re
import unicodedata
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import folding
from tidemark.functions.html import sanitized_pages
from tidemark.functions.urls import canonical_url, canonical_url_sql
from tidemark.plans.dialect import SPARK, Dialect
from tidemark.plans.run import duck_sql, spark_query

ALIGNED, ALIGNED_SINGLE = 0.67, 0.50


def html_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sanitized HTML of every page, as title, sizes and hash."""
    found = sanitized_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "title", F.sha2("sanitized_html", 256).alias("html_hash"), F.length("plain_text").alias("plain_n"))


def readable_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, taken only where it is at least 200 characters long."""
    found = sanitized_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    long_ = F.length("readable_text") >= F.greatest(F.lit(200), F.lit(0))
    return found.select("page_id", F.when(long_, F.col("readable_text")).alias("body"), long_.alias("accepted"))


def folded_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folded keys of first lines: case, diacritics and width folded."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", folding.fold_key(F.split_part("text", F.lit("\n"), F.lit(1))).alias("key"))


class Segment(NamedTuple):
    """A part of an item: its kind (whole, heading or paragraph) and the heading that it stands under."""

    text: str
    kind: str = "whole"
    heading: str = ""


def segments(text: str) -> list[Segment]:
    """Lines as headings (short, marked or without a stop) and paragraphs under the last heading; a single line is a whole."""
    lines = text.split("\n")
    if len(lines) == 1:
        return [Segment(text)]
    out, heading = [], ""
    for line in lines:
        kind = "heading" if len(line) < 100 and (line.startswith("#") or not re.search("[.。，]", line)) else "paragraph"
        heading = line if kind == "heading" else heading
        out.append(Segment(line, kind, heading))
    return out


def _bigrams(text: str) -> set[str]:
    x = "".join(unicodedata.normalize("NFC", text).lower().split())
    return {x[i : i + 2] for i in range(len(x) - 1)} if len(x) > 1 else set(x)


def similarity(a: Segment, b: Segment) -> float:
    """0.72 of the bigrams' Jaccard similarity, 0.18 of the ratio of lengths in bytes, 0.10 for the same heading; 0 for other kinds, unless one is a whole."""
    if a.kind != b.kind and "whole" not in (a.kind, b.kind):
        return 0.0
    x, y = _bigrams(a.text), _bigrams(b.text)
    jaccard = len(x & y) / len(x | y) if x | y else float(a.text == b.text)
    short, long_ = sorted((len(a.text.encode()), len(b.text.encode())))
    return 0.72 * jaccard + 0.18 * (short / long_ if long_ else 1.0) + 0.10 * (a.heading == b.heading)


def align(new: list[Segment], old: list[Segment]) -> list[tuple[int, int | None, float]]:
    """(place, prior or none, similarity): equal texts first, then greedily the most similar prior (ties: the first), each used once."""
    free, out = dict.fromkeys(range(len(old))), {}
    by_text: dict[str, list[int]] = {}
    for j in reversed(range(len(old))):
        by_text.setdefault(old[j].text, []).append(j)
    for i, own in enumerate(new):
        if by_text.get(own.text):
            j = by_text[own.text].pop()
            out[i] = (j, 1.0)
            del free[j]
    least = ALIGNED_SINGLE if len(new) == len(old) == 1 else ALIGNED
    for i, own in enumerate(new):
        if i not in out and free:
            score, j = max((similarity(own, old[j]), -j) for j in free)
            if score >= least:
                out[i] = (-j, score)
                del free[-j]
    return [(i, *out.get(i, (None, 0.0))) for i in range(len(new))]


def revision_alignment_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each turn, as headings and paragraphs, aligned with those of the turn before, conversation by conversation."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("text is not null")

    def run(own: pd.DataFrame) -> pd.DataFrame:
        rows, before = [], None
        for conv, turn, text in own.sort_values(["turn", "text"])[["conv_id", "turn", "text"]].itertuples(index=False):
            lines = segments(text)
            if before is not None:
                rows += [(conv, turn, i, j, round(s, 6)) for i, j, s in align(lines, before)]
            before = lines
        return pd.DataFrame(rows, columns=["conv_id", "turn", "place", "prior", "similarity"]).astype({"prior": "Int64"})

    return turns.groupBy("conv_id").applyInPandas(run, "conv_id long, turn long, place long, prior long, similarity double")


def math_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every text with marks of formulas, in their order, by a table function; a fifth of the texts end in formulas made for them."""
    made = r"concat(plain_text, ' so \\(x_', item_id, '\\) and $a+', item_id, '$, not \\$5 but $$', title, '$$')"
    texts = spark_query(lambda d: f"SELECT item_id, CASE WHEN item_id % 5 = 0 THEN {made} ELSE plain_text END AS body FROM v_items")(spark, sf_dir)
    spark.udtf.register("math_pieces", F.udtf(folding.MathPieces, returnType="place int, kind string, content string", useArrow=True))
    marked = texts.where("contains(body, '$') OR contains(body, '\\\\(') OR contains(body, '\\\\[')")
    return spark.sql("SELECT t.item_id, m.place, m.kind, length(m.content) AS n_chars, sha2(m.content, 256) AS content_hash FROM {t} t, LATERAL math_pieces(t.body) m", t=marked)


def _captures(d: Dialect) -> str:
    """Each page fetched three times: a third of them is edited before the second time, and some servers send no entity tag."""
    edited = "CASE WHEN capture > 0 AND page_id % 3 = 0 THEN 1 ELSE 0 END"
    body = f"CASE WHEN {edited} = 1 THEN concat(html, '<!-- edited -->') ELSE html END"
    times = " UNION ALL ".join(f"SELECT {n} AS capture" for n in range(3))
    return f"SELECT page_id, url, capture, {d.sha256(body)} AS body_hash, octet_length({body if d.spark else f'encode({body})'}) AS n_bytes, 1704067200 + 86400 * {edited} AS modified_at, page_id % 5 = 0 AS untagged FROM v_pages CROSS JOIN ({times}) t WHERE html IS NOT NULL AND url IS NOT NULL"


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_query(_captures)(spark, sf_dir).withColumn("site", canonical_url(F.col("url")))


_BEFORE = "lag({}) OVER (PARTITION BY site ORDER BY capture, page_id)"


def _changes(d: Dialect, sites: str) -> str:
    return f"SELECT page_id, capture, site, body_hash, {_BEFORE.format('body_hash')} IS NULL OR {_BEFORE.format('body_hash')} <> body_hash AS is_new FROM {sites}"


def page_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A web page as one item: a capture is a new revision where its whole body's hash differs from the one before of its canonical address."""
    return spark.sql(_changes(SPARK, "{s}"), s=_sites(spark, sf_dir))


#: Bytes of a response that are stored at most, a larger one is never reused.
STORED = 4096


def _fetches(d: Dialect, sites: str) -> str:
    tag = "CASE WHEN NOT untagged THEN substr(body_hash, 1, 16) END"
    small = lambda x: f"CASE WHEN n_bytes <= {STORED} THEN {x} END"
    sent = "coalesce(if_none_match = tag, if_modified_since >= modified_at, FALSE)"
    return f"""SELECT page_id, capture, site, if_none_match, if_modified_since, CASE WHEN {sent} THEN 304 ELSE 200 END AS status, CASE WHEN {sent} THEN stored_hash ELSE body_hash END AS served_hash, {sent} AS from_cache FROM (
        SELECT *, {_BEFORE.format(small("tag"))} AS if_none_match, {_BEFORE.format(small("modified_at"))} AS if_modified_since, {_BEFORE.format(small("body_hash"))} AS stored_hash FROM (SELECT *, {tag} AS tag FROM {sites}) x) y"""


def conditional_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetches by a cache of validators: an address's next fetch sends the stored entity tag and date; an unchanged body answers 304 and is served from the store.

    A tag decides where both sides have one, else the date; a response over the size limit is not stored, so the next fetch sends no validators.
    """
    return spark.sql(_fetches(SPARK, "{s}"), s=_sites(spark, sf_dir))


def _duck_sites(make) -> str:
    return duck_sql(lambda d: make(d, f"(SELECT *, {canonical_url_sql('url')} AS site FROM ({_captures(d)}) c) s"))


SPARK_QUERIES = {f.__name__: f for f in (html_sanitize, readable_extract, folded_names, revision_alignment_fuzzy, page_changes, conditional_get, math_rows)}
ORACLES = {"page_changes": _duck_sites(_changes), "conditional_get": _duck_sites(_fetches)}
