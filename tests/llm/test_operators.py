"""Each operator against brute force, on a table with nulls, copies, repeated rows, long texts and clashing columns."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import ann_postings, bk_forest, language_id, media_sequences, mixing, packing, shared, similar_groups, simhash_dedup, substring_dedup, token_counts, token_store, warc_revisit
from tidemark.llm.word_tokens import WordTokens

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)


def sorted_rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)


def test_language_id(spark, docs, no_docs):
    model = language_id.fit(docs)
    assert model.languages == ["de", "en"]
    found = {r["doc_id"]: r for r in language_id.predict(docs, model).collect()}
    own = {r["doc_id"]: r for r in docs.collect()}
    assert all(found[i]["lang_pred"] == own[i]["lang"] for i in range(40) if len(own[i]["text"].split()) > 20)
    assert [(found[i]["lang_pred"], found[i]["score"]) for i in (90, 91, 92, 93)] == [("und", 0.0)] * 4
    assert all(0 <= r["score"] <= 1 for r in found.values())
    assert language_id.predict(no_docs, model).count() == 0
    unknown = language_id.fit(no_docs)
    assert {r["lang_pred"] for r in language_id.predict(docs, unknown).collect()} == {"und"}
    carried = language_id.predict(docs, model, carry=True)
    assert carried.columns == [*docs.columns, "lang_pred_", "score"] and carried.count() == docs.count()


def test_language_learns_long_runs_and_words_that_occur_once(spark):
    run = "".join(chr(0x4E00 + i * 37 % 900) for i in range(200))
    docs = spark.createDataFrame([(1, run, "zh"), (2, "einmal", "de"), (3, None, "de"), (4, run[50:150], None)], "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    assert model.languages == ["de", "zh"] and model.find(0, ["einmal", run[:48], run[48:96]]).all() and model.find(5, [run[10:15]]).all()
    found = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(docs, model).collect()}
    assert found == {1: "zh", 2: "de", 3: "und", 4: "zh"}


def test_language_backoff_takes_the_longest_known_grams():
    model = language_id.Model.counted(["a", "b"], {0: {"known": [5, 1]}, 5: {"<zqwx": [1, 9]}, 1: {"z": [9, 0], "y": [0, 4]}})
    known, five, one = model.find(0, ["known"])[0], model.find(5, ["<zqwx"])[0], model.find(1, ["z"])[0]
    assert len({known, five, one, 0}) == 4 and max(known, five, one) <= 4 and model.find(5, ["known", "<zqw"]).tolist() == [0, 0]
    assert [r.tolist() for r in model.rows(["known", "zqwxy", "zz", "kk"])] == [[known], [five], [one, one], [0]]
    logs = model.logs(np.array([five, one, 0, known, one]))
    assert np.allclose(np.exp(logs[0]), 1) and np.allclose(np.exp(logs[1]), [9.5 / 10, 0.5 / 5]) and np.array_equal(logs[2], [0, 0]) and np.array_equal(logs[1], logs[4])
    assert np.allclose(model.scores(["zz", "zy"]), [logs[1], logs[1] / 2 + model.logs(model.find(1, ["y"]))[0] / 2])


def test_words_are_runs_of_letters():
    assert language_id.words_of("a½b ⅷ c² d_e 4f é") == ["a", "b", "c", "d", "e", "f", "é"] and language_id.words_of("x" * 100) == ["x" * 48, "x" * 48, "x" * 4]


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(docs.where("crc32(cast(doc_id as string)) % 4 <> 2"))
    held = docs.where("crc32(cast(doc_id as string)) % 4 = 2")
    found = language_id.predict(held, model).join(held.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) >= 0.98 * len(found)


def mixed_by_sorting(docs):
    rows = docs.collect()
    size = lambda t: len(t.encode().split()) if t else 0
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += size(r["text"])
    targets = mixing.share(dict(sizes), mixing.repeating_weights(list(sizes)), 3)
    units = defaultdict(lambda: defaultdict(list))
    for r in rows:
        seed = str(r["doc_id"]) if r["doc_id"] is not None else r["text"] or ""
        units[r["source"]][int(hashlib.md5(seed.encode()).hexdigest()[:15], 16)].append(r)
    out = []
    for s, by_hash in units.items():
        whole = int(targets[s] // sizes[s]) if sizes[s] else 0
        left, upto = targets[s] - whole * sizes[s], 0
        for h in sorted(by_hash):
            n = sum(size(r["text"]) for r in by_hash[h])
            more = 2 * upto + n <= 2 * left
            upto += n
            out += [(r["doc_id"], size(r["text"]), sizes[s], targets[s], size(r["text"]) * (whole + more)) for r in by_hash[h]]
    return sorted(out, key=key)


def test_mixing(docs, no_docs):
    found = mixing.mix(docs)
    assert sorted_rows(found, "doc_id", "size", "source_size", "target", "taken") == mixed_by_sorting(docs)
    assert all(r["taken"] <= 3 * r["size"] for r in found.collect())
    assert mixing.mix(no_docs).count() == 0
    carried = mixing.mix(docs, carry=True)
    assert carried.columns == [*docs.columns, "copies_"] and carried.count() == docs.count()


@given(st.dictionaries(st.text("ab", min_size=1, max_size=3), st.integers(0, 1000), min_size=1))
@settings(max_examples=60, deadline=None)
def test_shares_stay_below_the_cap_and_add_up(sizes):
    found = mixing.share(sizes, mixing.repeating_weights(list(sizes)), 3)
    assert all(found[s] <= 3 * n + 1e-9 for s, n in sizes.items())
    assert sum(found.values()) == pytest.approx(sum(sizes.values()))


@given(st.lists(st.tuples(st.text("abé日", min_size=1, max_size=30), st.sampled_from([" ", "\t ", "\n", " \x0b"])), max_size=12), st.sampled_from(["", " "]))
@settings(max_examples=200, deadline=None)
def test_word_hashes_are_of_words_wherever_they_stand(parts, head):
    data = (head + "".join(w + s for w, s in parts)).encode()
    chunk, shared.CHUNK_BYTES = shared.CHUNK_BYTES, 40
    try:
        assert shared.word_hashes(data).tolist() == [int(shared.word_hashes(w)[0]) for w in data.split()]
    finally:
        shared.CHUNK_BYTES = chunk


def removed_by_counting(rows, window):
    words = [(r["text"] or "").encode().split() for r in rows]
    n = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for r, w in zip(rows, words, strict=True):
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - window + 1):
            if n[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = True
        out.append((r["doc_id"], len(w), int(gone.sum()), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=key)


@pytest.mark.parametrize(("window", "hot"), [(35, 200), (35, 2), (12, 3), (5, 1)])
def test_substring_dedup(docs, no_docs, monkeypatch, window, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    found = substring_dedup.remove_repeats(docs, window)
    assert sorted_rows(found, "doc_id", "n_words", "n_removed", "kept_sha256") == removed_by_counting(docs.collect(), window)
    if hot == 2:
        assert substring_dedup.remove_repeats(no_docs, window).count() == 0
        left = substring_dedup.remove_repeats(docs, window, rewrite=True)
        assert left.columns == docs.columns and left.count() == docs.count()


@given(st.lists(st.text("ab", min_size=1, max_size=12), min_size=1, max_size=6), st.integers(1, 4))
@settings(max_examples=200, deadline=None)
def test_suffix_automaton_counts_windows(texts, window):
    automaton = substring_dedup.SuffixAutomaton()
    n = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    for t in texts:
        automaton.add(list(t), 1)
    automaton.count()
    for t in texts:
        assert automaton.repeats(list(t), window) == [n[t[i : i + window]] > 1 for i in range(len(t) - window + 1)]


def test_warc_revisit(spark):
    plain = lambda **x: {"capture_id": 0, "url": "http://A.example/x?utm_id=1#f", "ts": 0, "kind": "response", "etag": None, "last_modified": None, "payload_digest": None, "headers": None, "id": 9, "r": "clash"} | x
    data = [
        plain(capture_id=1, ts=10, etag="e1", payload_digest="d1", headers={"ETag": "e1", "Content-Type": "t"}),
        plain(capture_id=2, ts=20, etag="e2", payload_digest="d2", headers={"ETag": "e2", "Date": "old"}),
        plain(capture_id=3, ts=20, etag="e3", payload_digest="d3"),
        plain(capture_id=4, ts=15, kind="revisit", etag='W/"e"'.replace('"e"', "e1"), headers={"date": "new", "Content-Type": "no"}),
        plain(capture_id=5, ts=20, kind="revisit", etag="e1"),
        plain(capture_id=6, ts=9999, kind="revisit", etag="e3"), plain(capture_id=7, ts=9999, kind="revisit", etag="zz"),
        plain(capture_id=8, ts=10, kind="revisit", etag="e1"), plain(capture_id=9, ts=30, kind="revisit"), plain(capture_id=10, ts=None, kind="revisit"),
        plain(capture_id=11, url=None, ts=40, kind="revisit"), plain(capture_id=12, ts=50, kind="revisit", payload_digest="d3"), plain(capture_id=12, ts=50, kind="revisit", payload_digest="d3"),
    ]
    schema = "capture_id long, url string, ts long, kind string, etag string, last_modified string, payload_digest string, headers map<string,string>, id long, r string"
    table = spark.createDataFrame([tuple(x.values()) for x in data], schema)
    for slices in (1, 7, 64):
        found = warc_revisit.resolve_revisits(table, slices)
        got = sorted((r["capture_id"], r["response_id"] or 0, r["validated"]) for r in found.collect())
        assert got == [(4, 1, "etag"), (5, 1, "etag"), (6, 3, "etag"), (7, 0, "mismatch"), (8, 0, "missing"), (9, 0, "unchecked"), (10, 0, "missing"), (11, 0, "missing"), (12, 3, "digest"), (12, 3, "digest")]
    one = found.where("capture_id = 4").first()
    assert one["canonical_url"] == "http://a.example/x" and one["headers"] == {"etag": "e1", "content-type": "t", "date": "new"}
    assert warc_revisit.resolve_revisits(table.where("false")).count() == 0
    doubled = spark.createDataFrame([tuple(plain(capture_id=1, ts=1, etag="e", headers={"Vary": "a", "vary": "b", "X": "1", "x": "2"}).values()), tuple(plain(capture_id=2, ts=2, kind="revisit", etag="e", headers={"DATE": "c", "date": "d"}).values())], schema)
    assert warc_revisit.resolve_revisits(doubled).first()["headers"] == {"vary": "a", "x": "1", "date": "c"}


def test_packing(docs, no_docs):
    capacity, tokens = 200, Tokenizer.from_file(WORDS)
    found = packing.pack(docs, WORDS, end_id=1, capacity=capacity).collect()
    want = Counter()
    for r in docs.collect():
        ids = [*tokens.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        want.update((r["doc_id"], i, at, len(ids[at : at + capacity]), zlib.crc32(np.array(ids[at : at + capacity], "<u4").tobytes())) for i, at in enumerate(range(0, len(ids), capacity)))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == want
    by_sequence = defaultdict(list)
    for r in found:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by_sequence.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= capacity
    assert len(by_sequence) <= 1.05 * sum(r["length"] for r in found) / capacity + 1
    assert packing.pack(no_docs, WORDS).count() == 0


@given(st.dictionaries(st.integers(1, 50), st.integers(1, 30), min_size=1))
@settings(max_examples=150, deadline=None)
def test_packing_plan_is_best_fit_decreasing(counts):
    runs, capacity = packing.plan_runs(counts, 50), 50
    gaps: list[int] = []
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - n)
        else:
            gaps.append(capacity - n)
    used = defaultdict(int)
    for i, (length, rank, first, _) in enumerate(runs):
        end = runs[i + 1][1] if i + 1 < len(runs) and runs[i + 1][0] == length else counts[int(length)]
        for k in range(int(end - rank)):
            used[int(first) + k] += int(length)
    assert len(used) == len(gaps) and sorted(capacity - x for x in used.values()) == sorted(gaps)


def simhash_by_hand(rows):
    out = []
    for r in rows:
        w = (r["text"] or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        out.append((r["doc_id"], sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h)) if h else 0))
    return out


def joined_by_hand(items, linked):
    parent = list(range(len(items)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, x in enumerate(items):
        least[root(i)] += [x[0]] if x[0] is not None else []
    return sorted(((x[0], min(least[root(i)], default=None)) for i, x in enumerate(items)), key=key)


def test_simhash(docs, no_docs):
    rows = docs.collect()
    prints = simhash_by_hand(rows)
    found = simhash_dedup.near_duplicates(docs)
    assert sorted_rows(found, "doc_id", "fingerprint") == sorted(((i, f"{x:016x}") for i, x in prints), key=key)
    assert sorted_rows(found, "doc_id", "component_id") == joined_by_hand(prints, lambda a, b: (a[1] ^ b[1]).bit_count() <= 3)
    assert simhash_dedup.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("n", [10, 5_000_000, 1 << 40])
def test_blocks_lose_no_link(n):
    masks, r = simhash_dedup.block_masks(n, 3), np.random.default_rng(5)
    for _ in range(300):
        a, bits = int(r.integers(0, 1 << 63)), r.choice(64, 3, replace=False)
        b = a ^ sum(1 << int(k) for k in bits)
        assert any((a & m) % (1 << 64) == (b & m) % (1 << 64) for m in masks)


@pytest.mark.parametrize(("n", "words", "radius", "n_shards"), [(900, 1, 3, 20), (500, 4, 80, 3), (1, 1, 3, 1), (0, 1, 3, 1)])
def test_bk_forest_finds_what_a_scan_finds(n, words, radius, n_shards):
    r = np.random.default_rng(n)
    base = r.integers(0, 1 << 63, (max(1, n // 20), words)).astype(np.uint64)
    values = base[r.integers(0, len(base), n)] ^ (np.uint64(1) << r.integers(0, 64, (n, words)).astype(np.uint64))
    shard = np.sort(r.integers(0, n_shards, n))
    forest, found, part = bk_forest.Forest(values, shard), set(), np.arange(n)
    for asked, got, far in forest.searches(radius):
        assert np.array_equal(bk_forest.hamming(values[asked], values[got]), far)
        found |= set(zip(asked.tolist(), got.tolist(), strict=True))
        part, _ = bk_forest.unite(part, asked, got, far)
    want = {(i, int(j)) for i in range(n) for j in np.flatnonzero((shard == shard[i]) & (np.bitwise_count(values ^ values[i]).sum(axis=1) <= radius))}
    assert found == want
    assert [x for _, x in joined_by_hand([(i, i) for i in range(n)], lambda a, b: (a[0], b[0]) in want)] == part.tolist()


def test_bk_tree_follows_only_edges_within_the_radius():
    values = np.array([0, 0b1, 0b11, 0b111111, 1 << 40], np.uint64)
    forest = bk_forest.Forest(values, np.zeros(5, int))
    assert sorted(zip(forest.code // (1 << 16), forest.code % (1 << 16), forest.child, strict=True)) == [(0, 1, 1), (0, 2, 2), (0, 6, 3), (1, 2, 4)]


def kept_by_hand(rows, similarity=0.8, words=5):
    """Row numbers of one row of each group: the smallest id, null ids last."""
    sets = [frozenset(similar_groups.shingle_set(t, words).tolist()) for _, t in rows]
    groups = joined_by_hand(list(enumerate(sets)), lambda a, b: a[1] == b[1] or len(a[1] & b[1]) >= similarity * len(a[1] | b[1]))
    least = {}
    for i, g in groups:
        least[g] = min(least.get(g, i), i, key=lambda x: (rows[x][0] is None, rows[x][0] or 0))
    return sorted(least.values())


def test_similar_groups(docs, no_docs):
    rows = docs.collect()
    sets = [(r["doc_id"], frozenset(similar_groups.shingle_set(r["text"], 5).tolist())) for r in rows]
    alike = lambda a, b: a[1] == b[1] or len(a[1] & b[1]) >= 0.8 * len(a[1] | b[1])
    found = similar_groups.similar_groups(docs)
    assert sorted_rows(found, "doc_id", "component_id") == joined_by_hand(sets, alike)
    kept = similar_groups.keep_one(docs)
    assert kept.columns == docs.columns
    want = [rows[i]["doc_id"] for i in kept_by_hand([(r["doc_id"], r["text"]) for r in rows])]
    assert sorted_rows(kept, "doc_id") == sorted(((i,) for i in want), key=key) and want.count(None) == 1
    assert similar_groups.keep_one(no_docs).count() == 0


def test_keep_one_tells_rows_of_one_id_apart(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (1, b), (1, a), (2, a), (2, c), (None, b), (None, c.upper()), (None, "only here"), (None, "only here"), (3, None), (4, "")]
    kept = similar_groups.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted_rows(kept, "doc_id", "text") == sorted([(1, a), (1, b), (2, c), (None, "only here"), (3, None)], key=key)


@given(st.integers(1, 60), st.integers(0, 70), st.sampled_from([0.5, 0.8, 0.9]), st.integers(0, 5))
@settings(max_examples=200, deadline=None)
def test_similar_sets_share_a_shingle_of_their_prefixes(n, apart, similarity, n_common):
    r = np.random.default_rng(n * 100 + apart)
    all_ = r.integers(0, 1 << 63, n + apart).astype(np.uint64)
    one, other = np.unique(all_[:n]), np.unique(all_[apart // 2 :])
    common = np.unique(all_[:n_common])
    heads = [set(similar_groups.prefix(s, similarity, common, np.arange(len(common)) + 1).tolist()) for s in (one, other)]
    shared = len(np.intersect1d(one, other))
    if shared >= similarity * (len(one) + len(other) - shared):
        assert heads[0] & heads[1]


def test_similar_groups_match_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = [(r["doc_id"], frozenset(similar_groups.shingle_set(r["text"], 5).tolist())) for r in docs.collect()]
    found = similar_groups.similar_groups(docs)
    assert sorted_rows(found, "doc_id", "component_id") == joined_by_hand(sets, lambda a, b: len(a[1] & b[1]) >= 0.8 * len(a[1] | b[1]))


def test_media(docs, no_docs):
    found = {}
    for r in media_sequences.texts_as_media(docs).collect():
        found.setdefault(r["doc_id"], []).append(r)
    for r in docs.collect():
        raw = (r["text"] or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        same = [x for x in found[r["doc_id"]] if x["payload_sha256"] == hashlib.sha256(payload).hexdigest()]
        x = same[0]
        assert (x["n_bytes"], x["payload_bytes"], x["tail_crc32"]) == (len(raw), len(payload), zlib.crc32(payload[-32:]))
        stored = media_sequences.encode_png(payload)
        assert (x["media_bytes"], x["media_sha256"], x["feature"]) == (len(stored), hashlib.sha256(stored).hexdigest(), media_sequences.feature(payload))
        assert media_sequences.decode_png(stored) == payload and x["position"] == bool((r["text"] or "").split("\n")[0].split()) and x["caption"] == f"{len(raw)} bytes"
    assert sum(map(len, found.values())) == docs.count()
    assert media_sequences.texts_as_media(no_docs).count() == 0
    with pytest.raises(ValueError, match="broken"):
        media_sequences.decode_png(stored[:45] + bytes([stored[45] ^ 1]) + stored[46:])


def test_sequences_keep_order_positions_and_captions(spark):
    html = "<p>One</p><figure><figcaption>Cap</figcaption><img src='sha256:" + "a" * 64 + "' alt='x'></figure><script>no</script>Two <b>three</b><img src='u.png' alt='Alt'><video src='v'></video><p>End"
    table = spark.createDataFrame([(1, html, 3), (2, None, 4), (3, "", 5), (None, "<p>x<br>y", 6)], "page_id long, html string, kind int")
    found = {r["page_id"]: [(s["position"], s["kind"], s["text"], s["source"], s["digest"], s["caption"]) for s in r["sequence"]] for r in media_sequences.sequences(table).collect()}
    assert found[1] == [
        (0, "text", "One", None, None, None), (1, "media", None, "sha256:" + "a" * 64, "a" * 64, "Cap"), (2, "text", "Two three", None, None, None),
        (3, "media", None, "u.png", None, "Alt"), (4, "media", None, "v", None, None), (5, "text", "End", None, None, None),
    ]
    assert found[2] == found[3] == [] and [x[2] for x in found[None]] == ["x", "y"]


def test_pages_that_forget_to_close_are_read_on():
    said = lambda html: [x[1] for x in media_sequences.parse_sequence(html)]
    assert said("<html><head><title>t</title><meta charset=u><body><p>one<p>two") == ["one", "two"]
    assert said("<head><meta charset=u><p>one") == ["one"]
    assert said("<p>a</p><template><p>b") == ["a", "b"] and said("<p>a</p><template><p>b</template>c") == ["a", "c"]
    assert said("<template><template>x</template><p>y") == ["y"] and said("a<noscript>b</NOSCRIPT >c") == ["ac"]


def test_token_counts(docs, no_docs):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = sorted(((r["doc_id"], len((r["text"] or "").encode()), n := len(model.encode(r["text"] or "")), n > 100) for r in docs.collect()), key=key)
    assert sorted_rows(token_counts.count_tokens(docs, PIECES, limit=100), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert token_counts.count_tokens(no_docs, PIECES).count() == 0


_counts, _model = token_counts.SegmentCounts(PIECES, token_counts.prove(PIECES)), token_counts.load(PIECES)
_words = WordTokens(WORDS)
TEXT = st.text(st.sampled_from(list(" \n\tabthe'sSé|<>0½日▁́ßΣİ\x1c\x85\xa0\0🙂")), max_size=30) | st.text(max_size=20)


@given(TEXT)
@settings(max_examples=400, deadline=None)
def test_token_shortcuts_are_exact(text):
    assert _counts.count(text) == len(_model.encode(text))
    assert np.frombuffer(_words.ids(text), "<u4").tolist() == _words.whole.encode(text, add_special_tokens=False).ids


def test_token_store(docs, no_docs):
    tokens = Tokenizer.from_file(WORDS)
    store = token_store.write_store(docs, WORDS, end_id=2)
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, at = [], 0
    for i, text in rows:
        ids = [*tokens.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted_rows(store.read(store.keys()), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=key)
    assert store.get(95) == [*tokens.encode("one", add_special_tokens=False).ids, 2]
    assert store.get(12345) is None
    empty = token_store.write_store(no_docs, WORDS)
    assert empty.read(empty.keys()).count() == 0 and empty.get(1) is None


@given(st.sets(st.integers(0, 2**64 - 1), max_size=400))
@settings(max_examples=50, deadline=None)
def test_perfect_hash_is_minimal(keys):
    own = np.array(sorted(keys), np.uint64)
    assert sorted(token_store.PerfectHash.build(own).slots(own).tolist()) == list(range(len(own)))


def test_ann(spark):
    r = np.random.default_rng(3)
    v = r.normal(size=(3000, 16)) * r.uniform(0.5, 2, (3000, 1)) + 3 * np.eye(16)[r.integers(0, 16, 3000)]
    v[100:900] = v[100]  # a very common vector
    rows = [(i, [float(x) for x in np.float32(v[i])], 1, "x") for i in range(3000)]
    bad = [(5000, None, 1, "x"), (5020, [0.0] * 16, 1, "x"), (5040, [1.0, None] + [0.0] * 14, 1, "x"), (5060, [float("nan")] * 16, 1, "x"), (5080, [], 1, "x"), (None, rows[0][1], 1, "x")]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, list int, rank string").repartition(3)
    found = defaultdict(list)
    for x in ann_postings.search(table, table.where("vec_id % 100 = 0"), k=20).collect():
        found[x["query_id"]].append((x["rank"], x["vec_id"], x["score"]))
    assert sorted(found) == list(range(0, 3000, 100))
    data, hits = np.float32(v).astype(float), 0
    for q, own in found.items():
        scores = ann_postings.inner_products(np.repeat(data[q : q + 1], 3000, 0), data)
        scores[q] = -np.inf
        best = np.lexsort((np.arange(3000), -scores))[:20]
        own.sort()
        assert [x[0] for x in own] == list(range(1, 21)) and all(scores[i] == s for _, i, s in own)
        assert [(-s, i) for _, i, s in own] == sorted((-s, i) for _, i, s in own)
        hits += len({x[1] for x in own} & set(best.tolist()))
    assert hits >= 0.9 * 20 * len(found)
    mixed = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 2.0]), (1, [1.0, 0.0]), (2, [3.0, 1.0]), (3, [1.0, 1.0, 1.0]), (4, [2.0, 0.0, 0.0]), (5, [1.0])], "vec_id long, embedding array<double>")
    got = sorted_rows(ann_postings.search(mixed, mixed.where("vec_id in (1, 3, 5)"), k=20), "query_id", "query_copy", "rank", "vec_id", "score")
    assert got == [(1, 0, 1, 2, 2.0), (1, 0, 2, 1, 0.0), (1, 0, 3, 1, 0.0), (1, 1, 1, 2, 3.0), (1, 1, 2, 1, 1.0), (1, 1, 3, 1, 0.0), (1, 2, 1, 2, 3.0), (1, 2, 2, 1, 1.0), (1, 2, 3, 1, 0.0), (3, 0, 1, 4, 2.0)]
    few = table.where("vec_id < 5")
    got = ann_postings.search(few, few, k=20)
    assert sorted_rows(got.groupBy("query_id").count(), "query_id", "count") == [(i, 4) for i in range(5)]
    assert ann_postings.search(few.where("false"), few, k=20).count() == 0


def test_centroid_graph_finds_what_a_scan_finds():
    r = np.random.default_rng(2)
    c = r.normal(size=(600, 12))
    graph, same = ann_postings.CentroidGraph(c), 0
    for q in r.normal(size=(40, 12)):
        at, far = graph.search(q, 20)
        assert np.all(np.diff(far) >= 0)
        same += len(set(at.tolist()) & set(np.argsort(((c - q) ** 2).sum(axis=1))[:20].tolist()))
    assert same >= 0.97 * 40 * 20
