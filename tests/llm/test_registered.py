"""The registered queries, at their real limits, over written tables; and over empty ones."""

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.llm.test_operators import PIECES, WORDS, joined_by_hand, key, removed_by_counting, simhash_by_hand, sorted_rows
from tidemark.llm import queries

EMBEDDINGS = "vec_id long, embedding array<float>, label int"
PAGES = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{path}/documents.parquet")
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.float32(r.normal(size=8))], i % 3) for i in range(400)] + [(400, None, 0), (420, [0.0] * 8, 1), (440, [float("inf")] * 8, 2)]
    spark.createDataFrame(rows, EMBEDDINGS).repartition(3).write.parquet(f"{path}/embeddings.parquet")
    pages = [(i, f"http://A.example/{i % 5}?utm_id={i}", f"<p>{i % 7}</p>") for i in range(40)] + [(40, None, None), (41, "x", None)]
    spark.createDataFrame(pages, PAGES).repartition(3).write.parquet(f"{path}/pages.parquet")
    return path


@pytest.fixture(scope="module")
def empty(spark, no_docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("empty"))
    no_docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], EMBEDDINGS).write.parquet(f"{path}/embeddings.parquet")
    spark.createDataFrame([], PAGES).write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables_give_no_rows(spark, empty, name):
    found = queries.QUERIES[name](spark, empty)
    assert found.count() == 0 and len(found.columns) >= 3 and queries.QUERIES[name].__doc__


def test_op1(spark, folder, docs):
    found = queries.op1_language_id(spark, folder)
    assert found.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    said = defaultdict(list)
    for r in found.collect():
        said[r["doc_id"]].append(r)
    for r in docs.collect():
        own = said[r["doc_id"]]
        assert all(x["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for x in own)
        if r["doc_id"] in (90, 91, 92, 93):
            assert [(x["lang_pred"], x["score"]) for x in own] == [("und", 0.0)]
        elif r["lang"] and r["text"] and len(r["text"].split()) > 20:
            assert own[0]["lang_pred"] == r["lang"] and 0.5 < own[0]["score"] <= 1
    assert sum(map(len, said.values())) == docs.count()


@pytest.mark.parametrize("name", ["op2_source_mixing", "op4_warc_revisit"])
def test_queries_with_sql(spark, folder, name):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    found = queries.QUERIES[name](spark, folder)
    got = c.execute(queries.ORACLE_SQL[name])
    names = [x[0] for x in got.description]
    assert sorted_rows(found, *names) == sorted(got.fetchall(), key=key) and sorted(names) == sorted(found.columns)


def test_op3(spark, folder, docs):
    assert sorted_rows(queries.op3_substring_dedup(spark, folder), "doc_id", "n_words", "n_removed", "kept_sha256") == removed_by_counting(docs.collect(), 35)


def ids_of(tokens, text, end):
    return np.array([*tokens.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_op5(spark, folder, docs):
    tokens, want = Tokenizer.from_file(WORDS), Counter()
    for r in docs.collect():
        ids = ids_of(tokens, r["text"], 1)
        want.update((r["doc_id"], i, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())) for i, at in enumerate(range(0, len(ids), 4096)))
    rows = queries.op5_best_fit_packing(spark, folder).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want and max(r["piece"] for r in rows) >= 1
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by_sequence.values():
        ends = np.cumsum([0, *(n for _, n in sorted(own))])
        assert [o for o, _ in sorted(own)] == ends[:-1].tolist() and ends[-1] <= 4096
    assert len(by_sequence) == -(-sum(r["length"] for r in rows) // 4096)


def test_op6(spark, folder, docs):
    prints = simhash_by_hand(docs.collect())
    found = queries.op6_simhash_groups(spark, folder)
    assert sorted_rows(found, "doc_id", "fingerprint") == sorted(((i, f"{x:016x}") for i, x in prints), key=key)
    assert sorted_rows(found, "doc_id", "component_id") == joined_by_hand(prints, lambda a, b: (a[1] ^ b[1]).bit_count() <= 3)


def test_op7(spark, folder, docs):
    want = []
    for r in docs.collect():
        raw = (r["text"] or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        want.append((r["doc_id"], len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])))
    found = queries.op7_media_sequences(spark, folder)
    assert sorted_rows(found, "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32") == sorted(want, key=key)
    assert found.where("media_bytes is null or length(media_sha256) <> 64 or feature is null").count() == 0


def test_op8(spark, folder, docs):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = sorted(((r["doc_id"], len((r["text"] or "").encode()), n := len(model.encode(r["text"] or "")), n > 4096) for r in docs.collect()), key=key)
    assert sorted_rows(queries.op8_token_counts(spark, folder), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert {x[3] for x in want} == {True, False}


def test_op9(spark, folder, docs):
    tokens, want, at = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), [], 0
    for r in sorted(docs.collect(), key=lambda r: key((r["doc_id"], r["text"]))[0][::-1] if r["doc_id"] is None else (False, r["doc_id"])):
        if r["doc_id"] is None:
            continue
        want.append((r["doc_id"], len(ids := ids_of(tokens, r["text"], 2)), zlib.crc32(ids.tobytes())))
    found = queries.op9_token_store(spark, folder)
    assert sorted_rows(found.where("doc_id is not null"), "doc_id", "n_tokens", "ids_crc32") == sorted(want)
    for r in sorted(found.collect(), key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    ordered = [r["doc_id"] for r in sorted(found.collect(), key=lambda r: r["start"])]
    assert ordered == sorted(ordered, key=lambda i: -1 if i is None else i)


def test_op10(spark, folder):
    rows = {r["vec_id"]: np.array(r["embedding"], np.float64) for r in spark.read.parquet(f"{folder}/embeddings.parquet").where("vec_id < 400").collect()}
    found = defaultdict(list)
    for r in queries.op10_ann_postings(spark, folder).collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(found) == list(range(0, 400, 20))
    hits = 0
    for q, own in found.items():
        scores = {i: sum(a * b for a, b in zip(rows[q], v, strict=True)) for i, v in rows.items() if i != q}
        assert [x[0] for x in sorted(own)] == list(range(1, 21)) and all(abs(scores[i] - s) < 1e-9 for _, i, s in own)
        hits += len({x[1] for x in own} & set(sorted(scores, key=lambda i: (-scores[i], i))[:20]))
    assert hits >= 0.9 * 20 * len(found)
