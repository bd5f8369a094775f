"""Queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.urls import canonical_url_sql
from tidemark.llm.ann_postings import search
from tidemark.llm.language_id import fit, predict
from tidemark.llm.lexical_ranking import rank
from tidemark.llm.media_sequences import texts_as_media
from tidemark.llm.mixing import mix
from tidemark.llm.packing import pack
from tidemark.llm.periodic_runs import periodic_runs
from tidemark.llm.personal_data import KINDS, find_spans
from tidemark.llm.personal_data import fit as fit_spans
from tidemark.llm.shared import WORD
from tidemark.llm.simhash_dedup import near_duplicates
from tidemark.llm.substring_dedup import remove_repeats
from tidemark.llm.token_counts import count_tokens
from tidemark.llm.token_store import write_store
from tidemark.llm.warc_revisit import resolve_revisits


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language and score by a model of the documents whose id's crc32 mod 4 is not 2.

    Null texts and those without a letter are `und` with score 0; documents without id are not held out and teach nothing; ties
    go to the first language by code point; repeated rows give a row each; an empty table gives none.
    """
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    found = predict(docs, fit(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, with its source's size and target.

    A null text has size 0 and takes 0; a null source comes last in the weights' order; rows of one id are taken together;
    an empty table gives no rows.
    """
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS n, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
  FROM d GROUP BY source),
o AS (
  SELECT source, n, w, sum(n) OVER () AS total, row_number() OVER (ORDER BY 3.0 * n / w, source NULLS LAST) AS k FROM s WHERE n > 0),
c AS (
  SELECT *, total - coalesce(sum(3 * n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w
  FROM o),
f AS (
  SELECT *, min(CASE WHEN 3 * n * open_w < rest * w THEN 1 ELSE 0 END) OVER (ORDER BY k) AS capped FROM c),
g AS (
  SELECT *, min(CASE WHEN capped = 0 THEN k END) OVER () AS first_open FROM f),
t AS (
  SELECT g.source, g.n, CASE WHEN g.capped = 1 THEN CAST(3 * g.n AS DOUBLE)
         ELSE CAST(e.rest * g.w AS DOUBLE) / CAST(e.open_w AS DOUBLE) END AS target
  FROM g LEFT JOIN g AS e ON e.k = g.first_open),
b AS (SELECT source, n, target, CAST(floor(target / n) AS BIGINT) AS whole, target - floor(target / n) * n AS budget FROM t),
u AS (
  SELECT source, h, sum(size) AS own, sum(sum(size)) OVER (PARTITION BY source ORDER BY h ROWS UNBOUNDED PRECEDING) AS upto
  FROM d GROUP BY source, h)
SELECT d.doc_id, d.size, s.n AS source_size, coalesce(b.target, 0) AS target,
       CAST(d.size * coalesce(b.whole + CASE WHEN 2 * (u.upto - u.own) + u.own <= 2 * b.budget THEN 1 ELSE 0 END, 0) AS BIGINT) AS taken
FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source
LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source
LEFT JOIN u ON d.source IS NOT DISTINCT FROM u.source AND d.h = u.h
"""


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document, and what is left without repeated windows of 35 words.

    A null text has no words (the hash is that of no bytes); repeated rows repeat each other; texts under 35 words lose
    nothing; null ids give rows like any other; an empty table gives none.
    """
    return remove_repeats(table(spark, sf_dir, "documents"), window=35)


#: Captures made from pages: a full response at second page_id, and a not-modified record at second 3 * page_id whose
#: validators are, by the last digit of page_id, those of a page of that URL, out of date, or absent.
CAPTURES_SQL = """
SELECT page_id * 2 AS capture_id, url, page_id AS ts, 'response' AS kind, {etag} AS etag, CAST(NULL AS {string}) AS last_modified,
       {digest} AS payload_digest, page_id AS stamp FROM pages
UNION ALL
SELECT page_id * 2 + 1, url, page_id * 3, 'revisit',
       CASE page_id % 10 WHEN 0 THEN NULL WHEN 1 THEN 'old' ELSE {weak} END, CAST(NULL AS {string}),
       CASE page_id % 10 WHEN 0 THEN {digest} END, page_id * 3 FROM pages
"""


def op4_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisits made from pages, each with the full response that it stands for.

    Null urls match nothing; equal times go to the larger capture id; repeated pages give a row each; an empty table gives none.
    """
    etag = "substr(md5(html), 1, 8)"
    sql = CAPTURES_SQL.format(etag=etag, weak=f"'W/' || {etag}", digest="md5(html)", string="string").replace("FROM pages", "FROM {pages}")
    pair = lambda k, v: (F.lit(k), v)
    stamp = F.col("stamp").cast("string")
    full = F.create_map(*pair("Content-Type", F.lit("text/html")), *pair("ETag", F.col("etag")), *pair("Date", stamp))
    short = F.create_map(*pair("date", stamp), *pair("Cache-Control", F.lit("max-age=60")), *pair("Content-Length", F.lit("0")))
    captures = spark.sql(sql, pages=table(spark, sf_dir, "pages")).withColumn("headers", F.when(F.col("kind") == "response", full).otherwise(short))
    found = resolve_revisits(captures)
    entries = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return found.select("capture_id", "canonical_url", "response_id", "validated", "payload_digest", F.array_join(entries, ";").alias("merged_headers"))


_ETAG = "substr(md5(html), 1, 8)"
OP4_SQL = f"""
WITH c AS ({CAPTURES_SQL.format(etag=_ETAG, weak=f"'W/' || {_ETAG}", digest="md5(html)", string="VARCHAR")}),
u AS (SELECT *, {canonical_url_sql("url")} AS canonical_url FROM c),
r AS (
  SELECT *, max(CASE WHEN kind = 'response' THEN ts * 1000000000000 + capture_id END) OVER (
    PARTITION BY canonical_url ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS code
  FROM u),
m AS (
  SELECT r.capture_id, r.canonical_url, r.stamp, f.capture_id AS response_id, f.etag AS old_etag, f.payload_digest AS old_digest, f.stamp AS old_stamp,
         CASE WHEN f.capture_id IS NULL THEN 'missing'
              WHEN r.etag IS NOT NULL AND f.etag IS NOT NULL THEN CASE WHEN regexp_replace(r.etag, '^W/', '') = f.etag THEN 'etag' ELSE 'mismatch' END
              WHEN r.payload_digest IS NOT NULL AND f.payload_digest IS NOT NULL THEN CASE WHEN r.payload_digest = f.payload_digest THEN 'digest' ELSE 'mismatch' END
              ELSE 'unchecked' END AS validated
  FROM r LEFT JOIN u AS f ON f.kind = 'response' AND f.canonical_url = r.canonical_url AND f.capture_id = r.code % 1000000000000
  WHERE r.kind = 'revisit')
SELECT capture_id, canonical_url, CASE WHEN validated IN ('etag', 'digest') THEN response_id END AS response_id, validated,
       CASE WHEN validated IN ('etag', 'digest') THEN old_digest END AS payload_digest,
       CASE WHEN validated IN ('etag', 'digest')
            THEN 'cache-control=max-age=60;content-type=text/html;date=' || stamp || ';etag=' || old_etag END AS merged_headers
FROM m
"""


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces with their sequences and offsets.

    A null text is an empty one (its end id alone); repeated rows and null ids are packed like any other; an empty table
    gives no rows.
    """
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096)


def op6_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the smallest id that links of at most 3 bits reach.

    Null and empty texts have fingerprint zero; null ids name no component unless all of its ids are null; repeated rows
    give a row each; an empty table gives none.
    """
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, radius=3)


def op7_media_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text as a stored image, found through the figure of its page.

    A null text is an empty one; equal texts share one digest; repeated rows and null ids give rows like any other; an
    empty table gives none.
    """
    return texts_as_media(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document.

    A null text has none of either; repeated rows and null ids give rows like any other; an empty table gives none.
    """
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum, read back from a written store.

    A null text is an empty one (its end id alone); documents without id come first; rows of one id follow each other in
    the order of their texts; an empty table gives no rows.
    """
    store = write_store(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return store.read(store.keys())


def op10_ann_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20.

    Unusable vectors take no part; ties go to the smaller id; repeated ids are rows of their own; an empty table gives no rows.
    """
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data: how many spans of each exact form, their digest, and all spans.

    A null text is an empty one: no spans, the digest of no bytes, an empty string; spans that the method adds are in `spans` alone;
    repeated rows and null ids give rows like any other; an empty table gives none.
    """
    docs = table(spark, sf_dir, "documents")
    found = find_spans(docs, fit_spans(docs))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(said("base"), 256).alias("base_sha256"), said("spans").alias("spans"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's runs, a tenth of the documents made periodic from some word on, and the digest of what is left without repeats.

    A null text has no words: no runs, nulls for the longest, the digests of no bytes; a null id is never made periodic; repeated rows give
    rows like any other; an empty table gives none.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"))
    docs = docs.withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))).withColumn("n", F.size("words"))
    docs = docs.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    docs = docs.withColumn("p", F.lit(1) + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    word = lambda w, i: F.when(i < F.col("a"), w).otherwise(F.element_at("words", (F.col("a") + (i - F.col("a")) % F.col("p") + 1).cast("int")))
    docs = docs.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(F.transform("words", word), " ")).otherwise(F.col("text")).alias("text"))
    found = periodic_runs(docs)
    first = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("below"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), first.alias("first"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = -F.col("first.below"), F.col("first.period")
    return found.select("doc_id", "n_runs", F.col("first.start").alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_lexical_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item's 50 documents of highest score.

    Null texts and those without terms match nothing and count in no statistic; equal scores come by ascending id, null last; repeated rows are
    documents of their own, and rows of one item are one query; empty tables give no rows.
    """
    return rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TERMS = "unnest(regexp_extract_all(translate(text, '" + _UPPER + "', '" + _UPPER.lower() + r"'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
OP13_SQL = f"""
WITH d AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {_TERMS} AS term FROM documents) GROUP BY doc_id, term),
q AS (SELECT DISTINCT item_id, {_TERMS} AS term FROM benchmark),
s AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM d GROUP BY doc_id),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM s),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM d, c GROUP BY term, docs),
r AS (SELECT q.item_id, d.doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // words)))) AS BIGINT) AS score
  FROM q JOIN d USING (term) JOIN w USING (term) JOIN s ON s.doc_id = d.doc_id, c GROUP BY q.item_id, d.doc_id),
o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 50
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id, op2_source_mixing, op3_substring_dedup, op4_warc_revisit, op5_best_fit_packing,
        op6_simhash_groups, op7_media_sequences, op8_token_counts, op9_token_store, op10_ann_postings,
        op11_personal_data, op12_periodic_runs, op13_lexical_ranking,
    )
}
ORACLE_SQL: dict[str, str] = {"op2_source_mixing": OP2_SQL, "op4_warc_revisit": OP4_SQL, "op13_lexical_ranking": OP13_SQL}
