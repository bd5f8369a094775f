"""Personal data, periodic runs and ranked search against brute force, and their registered queries over written tables."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.test_operators import key, sorted_rows
from tidemark.llm import ann_postings, lexical_ranking, periodic_runs, personal_data, queries

# ---- personal data


def base_by_hand(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by the stated patterns, as plain regular expressions."""
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(s: str) -> bool:
        own = [int(c) for c in digits(s)][::-1]
        return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(own)) % 10 == 0

    rules = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(s)),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ]
    return [(k, *m.span()) for k, (pattern, test) in enumerate(rules) for m in re.finditer(pattern, text) if test(m[0])]


def flat(found: dict) -> list[tuple[int, int, int]]:
    return [(k, s, e) for k, kind in enumerate(personal_data.KINDS) for s, e in found[kind]]


PARTS = st.sampled_from(["a@b.co", "@", ".", "-", "x", "é", " ", "\n", "1", "12", "255", "300", "1.2.3.4", "4111 1111 1111 1111", "4111-1111", "+49", "+1 (212) 555-0100", "(", ")", "日", "a.b", "@b.c.d", "0" * 7, "."])


@given(st.lists(PARTS, max_size=30).map("".join))
@settings(max_examples=600, deadline=None)
def test_base_spans_are_those_of_the_patterns(text):
    assert flat(personal_data.base_spans(text)) == base_by_hand(text)


def test_base_spans_take_linear_time():
    start = time.perf_counter()
    for text in ("a" * 400_000, "1" * 400_000, "a.b-c@" * 80_000, "1." * 200_000, "+1" * 200_000, "+1(" + "(" * 400_000, "@a" * 200_000, "a at " * 100_000, "1:" * 200_000):
        assert all(s < e for _, s, e in flat(personal_data.base_spans(text)))
        list(personal_data.candidates(text))
    assert time.perf_counter() - start < 20


def made(seed: int, n: int) -> list[tuple[str, list[tuple[str, str]], list[str]]]:
    """(text, personal data beyond the exact forms, decoys): each in a sentence of its own."""
    r, out = random.Random(seed), []
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8)))
    for i in range(n):
        real, decoys, lines = [], [], [" ".join(word() for _ in range(20))]
        lines.append(f"mail {word()}@{word()}.com or call +1 (2{i % 90 + 10}) 555-{1000 + i % 9000}, host 10.{i % 200}.3.4")
        spoken = f"{word()} (at) {word()} dot org"
        lines.append(f"please write to {spoken} soon")
        real.append(("email", spoken))
        dialled = f"(0{r.randint(10, 99)}) {r.randint(200, 999)} {r.randint(1000, 9999)}"
        lines.append(f"phone {dialled} today")
        real.append(("phone", dialled))
        version = f"{r.randint(1, 9)}:{r.randint(10, 59)}:{r.randint(10, 59)}"
        lines.append(f"time {version} is late")
        decoys.append(version)
        order = f"{r.randint(10**15, 10**16 - 1)}1"
        while personal_data.luhn(order):
            order = f"{r.randint(10**15, 10**16 - 1)}1"
        lines.append(f"order {order} shipped")
        decoys.append(order)
        out.append(("\n".join(lines), real, decoys))
    return out


@pytest.fixture(scope="module")
def personal(spark):
    rows = made(3, 60)
    docs = spark.createDataFrame([(i, t, "x") for i, (t, _, _) in enumerate(rows)] + [(900, None, ""), (901, "", ""), (None, "a@b.co", ""), (5, rows[5][0], "")], "doc_id long, text string, spans string").repartition(3)
    return rows, docs, personal_data.fit(docs)


def test_personal_data_beyond_the_exact_forms(personal):
    rows, docs, model = personal
    found = {}
    for r in personal_data.find_spans(docs, model).collect():
        found.setdefault(r["doc_id"], []).append(r)
    assert [len(found[i][0]["spans"]) for i in (900, 901)] == [0, 0] and len(found[5]) == 2 and len(found[None][0]["base"]) == 1
    hits = misses = 0
    for i, (text, real, decoys) in enumerate(rows):
        own = found[i][0]
        spans = [(s["kind"], s["start"], s["end"]) for s in own["spans"]]
        assert [(personal_data.KINDS.index(s["kind"]), s["start"], s["end"]) for s in own["base"]] == base_by_hand(text)
        assert {(s["kind"], s["start"], s["end"]) for s in own["base"]} <= set(spans) and spans == sorted(spans, key=lambda s: (personal_data.KINDS.index(s[0]), s[1]))
        said = [(k, text[s:e]) for k, s, e in spans]
        hits += sum(x in said for x in real)
        misses += sum(x not in said for x in real)
        assert not [d for d in decoys if any(d in s for _, s in said)]
    assert hits >= 0.9 * (hits + misses)


def test_reliabilities_tell_labelers_apart():
    r = np.random.default_rng(1)
    truth = r.random(4000) < 0.3
    right = np.array([0.95, 0.9, 0.8, 0.7, 0.5])
    votes = np.where(r.random((4000, 5)) < right, truth[:, None], ~truth[:, None])
    masks = sum(np.where(votes[:, k], 1 << 2 * k, 1 << 2 * k + 1) for k in range(5))
    kinds, counts = np.unique(masks, return_counts=True)
    chance, share, tables = personal_data.estimate(kinds, counts.astype(float))
    assert abs(share - 0.3) < 0.05 and np.all(np.diff(tables[1, :, 2]) < 0.02)
    said = dict(zip(kinds.tolist(), chance, strict=True))
    assert np.mean((np.array([said[m] for m in masks.tolist()]) > 0.5) == truth) > 0.95


# ---- periodic runs


def runs_by_hand(words: list) -> list[tuple[int, int, int]]:
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(12, 2 * q) and not any(all(words[i + k] == words[i + k + p] for k in range(length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out)


@st.composite
def periodic(draw):
    n, kinds = draw(st.integers(0, 90)), draw(st.sampled_from([1, 2, 3, 60]))
    r = random.Random(draw(st.integers(0, 10**6)))
    words = [r.randrange(kinds) for _ in range(n)]
    for _ in range(draw(st.integers(0, 3))):
        if n > 4:
            a = r.randrange(n)
            p, end = r.randint(1, max(1, (n - a) // 2)), r.randint(a, n)
            words[a:end] = [words[a + (i - a) % p] for i in range(a, end)]
    return words


@given(periodic())
@settings(max_examples=500, deadline=None)
def test_runs_are_those_of_a_scan(words):
    found = periodic_runs.find_runs(periodic_runs.word_ids([b"%d" % w for w in words]))
    assert found == runs_by_hand(words)
    held = [any(s + p <= i < s + k for s, k, p in found) for i in range(len(words))]
    assert periodic_runs.dropped(len(words), found).tolist() == held


def test_long_periods_and_long_texts():
    r, words = np.random.default_rng(2), np.random.default_rng(1).integers(0, 4000, 20_000)
    words[300:] = np.resize(words[300:6300], 19_700)
    assert periodic_runs.find_runs(words) == [(300, 19_700, 6000)]
    assert periodic_runs.find_runs(np.zeros(20_000, np.int64)) == [(0, 20_000, 1)]
    assert periodic_runs.find_runs(r.integers(0, 4000, 20_000)) == []


# ---- ranked search


@given(st.lists(st.integers(0, 1 << 62) | st.integers(0, 300), max_size=60))
@settings(max_examples=200, deadline=None)
def test_packed_numbers_come_back(values):
    assert lexical_ranking.unpacked(lexical_ranking.packed(np.array(values, np.int64))).tolist() == values


def terms_by_hand(text) -> list[str]:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def ranked_by_hand(docs, items, k=50):
    """(item, rank, score) and the ids by item and score: rows of one id and score may change places."""
    own = [(r["doc_id"], Counter(terms_by_hand(r["text"]))) for r in docs]
    own = [(i, c, sum(c.values())) for i, c in own if c]
    n, total = len(own), sum(x for _, _, x in own)
    df = Counter(t for _, c, _ in own for t in c)
    wanted = {}
    for i, text in items:
        wanted.setdefault(i, set()).update(terms_by_hand(text))
    out = []
    for i, terms in wanted.items():
        scored = []
        for d, c, size in own:
            m = 50 + 50 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if s > 0:
                scored.append((-s, d is None, d if d is not None else 0, d))
        out += [(i, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=key)


ITEMS = [(1, "The der, of THE aming!"), (2, None), (3, "?"), (None, "und zu"), (1, "mit"), (4, "日本語 🙂 nothingatall"), (5, "nowhere"), (6, "one dhing row without id the of")]


@pytest.mark.parametrize(("k", "shard"), [(50, 16_384), (3, 7), (1, 1)])
def test_ranking_by_hand(spark, docs, no_docs, monkeypatch, k, shard):
    monkeypatch.setattr(lexical_ranking, "SHARD_DOCS", shard)
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, doc_id string")
    found = lexical_ranking.rank(docs, items, k=k)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted_rows(found, *found.columns) == ranked_by_hand(docs.collect(), ITEMS, k)
    assert lexical_ranking.rank(no_docs, items).count() == 0 and lexical_ranking.rank(docs, items.limit(0)).count() == 0


def test_blocks_of_queries_and_clashing_names(spark, docs, monkeypatch):
    monkeypatch.setattr(lexical_ranking, "BLOCK_BYTES", 20)
    items = spark.createDataFrame(ITEMS, "id long, q string")
    found = lexical_ranking.rank(docs.withColumnRenamed("doc_id", "score"), items, k=5, id_col="score", query_id_col="id", query_text_col="q")
    assert found.columns == ["id", "rank", "score_", "score"]
    assert sorted_rows(found, *found.columns) == ranked_by_hand(docs.collect(), ITEMS, 5)


# ---- the registered queries


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def test_op11(spark, folder, docs):
    want = []
    for r in docs.collect():
        own = base_by_hand(r["text"] or "")
        counts = Counter(k for k, _, _ in own)
        want.append((r["doc_id"], *(counts[k] for k in range(4)), sha(",".join(f"{personal_data.KINDS[k]}:{s}:{e}" for k, s, e in own))))
    found = queries.op11_personal_data(spark, folder)
    assert sorted_rows(found, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == sorted(want, key=key)
    assert all(re.fullmatch(r"((email|ip|card|phone):\d+:\d+,?)*", r["spans"]) for r in found.collect())


def test_op12(spark, folder, docs):
    want = []
    for r in docs.collect():
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", r["text"] or "") if w]
        h, n = (zlib.crc32(str(r["doc_id"]).encode()) if r["doc_id"] is not None else 1), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = periodic_runs.find_runs(periodic_runs.word_ids([w.encode() for w in words])) if n > 500 else runs_by_hand(words)
        kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + k for s, k, q in runs)]
        first = min(((-k, s, q) for s, k, q in runs), default=None)
        best = (first[1], -first[0], first[2], 1000 * -first[0] // first[2]) if first else (None,) * 4
        want.append((r["doc_id"], len(runs), *best, sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(" ".join(kept))))
    found = queries.op12_periodic_runs(spark, folder)
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted_rows(found, *found.columns) == sorted(want, key=key) and sum(w[1] > 0 for w in want) >= 3


def test_op13_and_its_sql(spark, folder, docs):
    found = queries.op13_lexical_ranking(spark, folder)
    assert sorted_rows(found, "item_id", "rank", "doc_id", "score") == ranked_by_hand(docs.collect(), ITEMS)
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    rows = queries.op13_lexical_ranking(spark, "/root/testdata/sf0.001")
    assert sorted_rows(rows, "item_id", "rank", "doc_id", "score") == sorted(c.execute(queries.ORACLE_SQL["op13_lexical_ranking"]).fetchall(), key=key)


# ---- nearest neighbours of queries whose lists hold too few


def test_a_far_group_of_fewer_than_k_finds_all(spark):
    r = np.random.default_rng(3)
    near = [(i, [10 + float(x) for x in r.normal(0, 0.1, 1)] + [float(x) for x in r.normal(0, 0.1, 3)]) for i in range(590)]
    far = [(10_000 + 20 * i, [0.0, 10.0 + 0.01 * i, float(r.normal(0, 0.1)), 0.0]) for i in range(10)]
    rows = dict(near + far)
    vectors = spark.createDataFrame(near + far, "vec_id long, embedding array<double>").repartition(3)
    asked = vectors.where("vec_id >= 10000")
    found = {}
    for x in ann_postings.search(vectors, asked, k=20).collect():
        found.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"]))
    assert sorted(found) == [10_000 + 20 * i for i in range(10)]
    for q, own in found.items():
        score = lambda i, q=q: sum(a * b for a, b in zip(rows[q], rows[i], strict=True))
        want = sorted((i for i in rows if i != q), key=lambda i: (-score(i), i))[:20]
        assert [i for _, i in sorted(own)] == want


def test_the_share_of_lists_decides_where_there_are_many(spark, monkeypatch):
    monkeypatch.setattr(ann_postings, "LIST_AIM", 16)
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = vectors.toPandas()
    x, ids = np.stack(rows["embedding"].values).astype(float), rows["vec_id"].to_numpy()

    def recall(share):
        found, hits = {}, []
        for r in ann_postings.search(vectors, vectors.where("vec_id % 40 = 0"), k=20, probes=8, share=share).collect():
            found.setdefault(r["query_id"], set()).add(r["vec_id"])
        for q in np.flatnonzero(ids % 40 == 0):
            score = x @ x[q]
            score[q] = -np.inf
            hits.append(len(found[int(ids[q])] & set(ids[np.argsort(-score)[:20]].tolist())) / 20)
        return np.mean(hits)

    assert recall(0.0) + 0.2 < recall(0.5) >= 0.9
