"""The training-data operators on small tables: against brute force, and in the cases that their docstrings define."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlake.llm import decontamination, jaccard, lpf, quality, sharding, spans, tokens, topk, toxicity, warc
from lumenlake.llm.bytewords import Batch, encoded
from lumenlake.llm.queries import vocabulary_path

DOCS = "doc_id long, text string, lang string, source string, score double, shard int, key string"
ODD = [None, "", " ", "one", "Same text here.", "Same text here.", "é" * 30, "x" * 3000]


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def frame(spark, texts, ids=None):
    """Documents with columns that clash with the operators' own."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, None, None, 0.5, 3, None) for i, t in zip(ids, texts, strict=True)], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and a null id."""
    return frame(spark, [*ODD, "Same text here.", None], [0, 1, 2, 3, 4, 5, 6, 7, 4, None])


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


# --- op1, op5 ---------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(1)
    texts, labels = [], []
    for i in range(240):
        toxic, good = int(i % 4 == 0), int(i % 3 != 0)
        t = words(rng, 50) + (" awfulword nastyterm" if toxic else "")
        texts.append(t if good else t.replace(" ", "$$ "))
        labels.append((i, good, toxic))
    return frame(spark, texts), spark.createDataFrame([*labels, (1000, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def test_scores(spark, labelled, odd, empty):
    docs, labels = labelled
    held = {i for i in range(240) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert not {t for t, _ in toxicity.training_rows(docs, labels, "toxic", 500)} & {r.text for r in docs.collect() if r.doc_id in held}
    assert len(toxicity.training_rows(docs, labels, "toxic", 20)) == 20
    model, net = toxicity.train(docs, labels), quality.train(docs, labels)
    for scored, label, threshold in ((toxicity.score_documents(docs, model), 2, toxicity.THRESHOLD), (quality.score_documents(docs, net), 1, quality.THRESHOLD)):
        got = {r.doc_id: r.score for r in scored.collect()}
        truth = {r[0]: r[label] for r in labels.collect()}
        assert scored.columns == docs.columns
        assert sum((got[i] >= threshold) == (truth[i] == 1) for i in held) >= 0.9 * len(held)
    for score, m in ((toxicity.score_documents, model), (quality.score_documents, net)):
        got = score(odd, m).collect()
        assert len(got) == 10 and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.text in (None, "")}) == 1 and len({r.score for r in got if r.text == "Same text here."}) == 1
        assert score(empty, m).count() == 0
    bare = labels.limit(0)
    assert {r.score for r in toxicity.score_documents(odd, toxicity.train(odd, bare)).collect()} == {0.0}
    assert {r.score for r in quality.score_documents(odd, quality.train(odd, bare)).collect()} == {0.5}


# --- op2 --------------------------------------------------------------------------------------------------------

def brute_removal(texts, length, first=None):
    """Kept bytes of every text, any copy of a string being removed; with `first`, an order: all but the first."""
    raw = [(t or "").encode() for t in texts]
    places = collections.defaultdict(list)
    for d in first or range(len(raw)):
        for p in range(len(raw[d]) - length + 1):
            places[raw[d][p : p + length]].append((d, p))
    gone = [set() for _ in raw]
    for found in places.values():
        if len(found) > 1:
            for d, p in found[1:] if first else found:
                gone[d].update(range(p, p + length))
    return [bytes(b for i, b in enumerate(r) if i not in g) for r, g in zip(raw, gone, strict=True)]


@pytest.fixture(scope="module")
def repeats():
    rng = random.Random(9)
    shared = [words(rng, 30) for _ in range(3)]
    texts = [words(rng, 20) + rng.choice(shared)[rng.randint(0, 40) :] + words(rng, rng.randint(0, 20)) for _ in range(25)]
    return [*texts, "ab" * 200, "For " * 120, texts[0], texts[0], None, "", "short", shared[0]]


def test_lpf_removes_all_copies(spark, repeats):
    got = {r.doc_id: r for r in lpf.remove_repeats(frame(spark, repeats), length=64).collect()}
    for i, kept in enumerate(brute_removal(repeats, 64)):
        raw = (repeats[i] or "").encode()
        assert bytes(got[i].kept) == kept and got[i].n_bytes == len(raw) and got[i].n_removed == len(raw) - len(kept)
        assert got[i].kept_sha256 == hashlib.sha256(kept).hexdigest() and (got[i].n_spans > 0) == (len(raw) > len(kept))


def test_lpf_keeps_the_first_copy(spark, repeats):
    texts = list(dict.fromkeys(t for t in repeats if t))
    order = sorted(range(len(texts)), key=lambda i: hashlib.md5(texts[i].encode()).digest())
    got = {r.doc_id: bytes(r.kept) for r in lpf.remove_repeats(frame(spark, texts), length=64, keep="first").collect()}
    assert got == dict(enumerate(brute_removal(texts, 64, order)))
    copies = lpf.remove_repeats(frame(spark, [texts[0]] * 3, [5, 2, 9]), length=64, keep="first").collect()
    assert {r.doc_id for r in copies if r.n_removed == 0} == {2}


def test_lpf_splits_hot_keys(spark, monkeypatch):
    """A key with many kinds of chunk is dealt out by strings without loss."""
    monkeypatch.setattr(lpf, "KINDS", 4)
    rng = random.Random(12)
    core = words(rng, 40)
    texts = [words(rng, 3) + core[rng.randint(0, 30) : len(core) - rng.randint(0, 30)] + words(rng, 3) for _ in range(40)]
    got = {r.doc_id: bytes(r.kept) for r in lpf.remove_repeats(frame(spark, texts), length=64).collect()}
    assert got == dict(enumerate(brute_removal(texts, 64)))


def test_lpf_counts_the_strings_of_very_hot_keys(spark, monkeypatch):
    """A key of more kinds than its parts can hold is decided by two hashes of each string."""
    monkeypatch.setattr(lpf, "KINDS", 2)
    monkeypatch.setattr(lpf, "PARTS", 3)
    rng = random.Random(13)
    core = words(rng, 40)
    texts = [words(rng, 3) + core[rng.randint(0, 30) : len(core) - rng.randint(0, 30)] + words(rng, 3) for _ in range(40)]
    got = {r.doc_id: bytes(r.kept) for r in lpf.remove_repeats(frame(spark, texts), length=64).collect()}
    assert got == dict(enumerate(brute_removal(texts, 64)))
    order = sorted(range(len(texts)), key=lambda i: hashlib.md5(texts[i].encode()).digest())
    got = {r.doc_id: bytes(r.kept) for r in lpf.remove_repeats(frame(spark, texts), length=64, keep="first").collect()}
    assert got == dict(enumerate(brute_removal(texts, 64, order)))


def test_lpf_odd_tables(spark, odd, empty):
    got = rows(lpf.remove_repeats(odd), "doc_id", "n_bytes", "n_removed")
    assert (7, 3000, 3000) in got and (0, 0, 0) in got and (None, 0, 0) in got and len(got) == 10
    assert lpf.remove_repeats(empty).count() == 0


# --- op3 --------------------------------------------------------------------------------------------------------

def test_warc_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 3)
    long = "<p>" + "payload " * 30
    data = [(i, f"http://www.s{i % 4}.example.com/p/{i}", f"<html>{i} " + "text " * i) for i in range(30)]
    data += [(40, "http://a.example.com/x\ty", long), (38, None, long), (39, "http://a.example.com/x\ty", long), (41, "no url", None), (42, "", ""), (43, "http://a.b/", "tiny"), (44, "http://a.b/", "tiny"), (None, "http://c.d/", long), (45, "http://A.b:80/q?x=1", "é" * 60), (45, "http://A.b:80/q?x=1", "é" * 60)]
    pages = spark.createDataFrame([(*r, "x", "y") for r in data], "page_id long, url string, html string, key string, file string").repartition(3)
    want = []
    firsts = {}
    for i, _, html in data:
        if len((html or "").encode()) >= 100 and i is not None:
            firsts[html] = min(i, firsts.get(html, i))
    for i, _, html in data:
        raw = (html or "").encode()
        first = firsts.get(html) if sum(h == html for _, _, h in data) > 1 and len(raw) >= 100 else None
        revisit = first is not None and i != first
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    got = warc.round_trip(pages)
    assert rows(got, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(want, key=str)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_capture_index_finds_single_keys(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h{i % 7}.org/{i}", "body" * i) for i in range(200)], "page_id long, url string, html string")
    folder = f"file://{tmp_path}"
    captures = warc.write_archives(pages, f"{folder}/warc")
    directory = warc.build_index(captures, f"{folder}/index")
    wanted = spark.createDataFrame([("org,h3)/17", 17), ("org,h0)/9999", 9999), ("zzz", 1)], "key string, page_id long")
    places = warc.look_up(wanted, directory, f"{folder}/index").collect()
    assert [p.page_id for p in places] == [17]
    assert warc.read_records(spark.createDataFrame(places), f"{folder}/warc").first().payload_bytes == 68
    assert [r[0] for r in spark.createDataFrame([("https://u:p@WWW.a.b.Com:8080/x?y",)], "u string").select(warc.url_key(F.col("u"))).collect()] == ["com,b,a,www)/x?y"]


def test_raw_tabs_and_line_ends_in_urls_do_not_upset_the_order(spark, monkeypatch):
    ends = ["", "\ty", " y", "#f", "!", "\"", "$z", "\ny", "\r", "%09y", "%0", "&"]
    pages = spark.createDataFrame([(i, f"http://a.b/x{e}", f"page {i}") for i, e in enumerate(ends)], "page_id long, url string, html string")
    for block in (1024, 3):
        monkeypatch.setattr(warc, "BLOCK", block)
        assert rows(warc.round_trip(pages), "page_id") == sorted(((i,) for i in range(len(ends))), key=str)


# --- op4 --------------------------------------------------------------------------------------------------------

def test_sharding(spark, odd, empty):
    docs = frame(spark, [f"text {i}" for i in range(4000)])
    got = sharding.shard_rows(docs).collect()
    by_shard = collections.defaultdict(list)
    for r in got:
        assert r.size == len(f"text {r.doc_id}") + 1 and r.text_crc32 == zlib.crc32(f"text {r.doc_id}".encode()) and r.law == "key"
        assert r.grown_shard in (r.shard, 8)
        by_shard[r.shard].append(r.slot)
    assert set(by_shard) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert all(400 < len(s) < 600 for s in by_shard.values()) and 330 < sum(r.grown_shard == 8 for r in got) < 560
    part = {r.doc_id: r.shard for r in sharding.shard_rows(docs.where("doc_id % 7 = 3").repartition(5)).collect()}
    assert all(part[r.doc_id] == r.shard for r in got if r.doc_id in part)
    strange = sharding.shard_rows(odd).collect()
    assert len(strange) == 10 and {(r.size, r.text_crc32) for r in strange if r.doc_id in (0, 1, None)} == {(1, 0)}
    assert len({r.shard for r in strange if r.doc_id == 4}) == 1 and len({(r.shard, r.slot) for r in strange}) == 10
    assert sharding.shard_rows(empty).count() == 0


def test_a_changed_weight_moves_rows_in_its_subtree_only(spark):
    docs = frame(spark, ["x"] * 3000)
    before = {r.doc_id: r.shard for r in sharding.shard_rows(docs).collect()}
    heavier = sharding.tree([[[(0, 1.0), (1, 1.0)], [(2, 1.0), (3, 1.0)]], [[(4, 1.0), (5, 1.0)], [(6, 1.0), (7, 3.0)]]])
    after = {r.doc_id: r.shard for r in sharding.shard_rows(docs, heavier).collect()}
    moved = {(before[i], after[i]) for i in before if before[i] != after[i]}
    assert moved and all(b in (6, 7) or (a < 4 <= b) or (a in (4, 5) and b in (6, 7)) for a, b in moved)
    assert not any(a >= 4 > b for a, b in moved)


# --- op6 --------------------------------------------------------------------------------------------------------

def test_encoding(spark, odd, empty):
    got = tokens.encode_documents(odd, vocabulary_path())
    assert got.columns == [*odd.columns, "n_tokens", "ids_sha256", "decoded_sha256"]
    codec = tokens.Codec(open(vocabulary_path(), encoding="utf-8").read())
    for r in got.collect():
        ids = codec.tokenizer.encode(r.text or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
    assert tokens.encode_documents(empty.withColumn("n_tokens", F.lit(1)), vocabulary_path()).count() == 0


# --- op7 --------------------------------------------------------------------------------------------------------

def test_search(spark):
    rng = random.Random(3)
    data = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(120)]
    data += [(200 + i, data[3][1]) for i in range(30)] + [(50, data[50][1]), (250, None), (251, [1.0, None]), (252, [float("nan")] * 6), (253, [float("inf")] * 6), (300, [0.5, 0.5]), (301, [0.25, 0.5]), (350, []), (None, [1.0] * 6)]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in data], "vec_id long, embedding array<float>, rank int, score long").repartition(4)
    got = topk.search(table, F.col("vec_id") % 50 == 0)
    clean = [(r.vec_id, [float(x * 256 // 1) for x in r.embedding]) for r in table.collect() if r.vec_id is not None and r.embedding is not None and all(x is not None and abs(x) < 1e30 for x in r.embedding)]
    want = set()
    for q, v in {(i, tuple(v)) for i, v in clean if i % 50 == 0}:
        found = sorted(((sum(int(a) * int(b) for a, b in zip(v, w, strict=True)), i) for i, w in clean if i != q and len(w) == len(v)), key=lambda t: (-t[0], t[1]))[:5]
        want |= {(q, k + 1, i, s) for k, (s, i) in enumerate(found)}
    assert set(rows(got, "query_id", "rank", "vec_id", "score")) == want and got.count() == len(want)
    assert topk.search(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_every_vector_of_one_id_is_answered(spark):
    """More queries of one id than a block holds: each is answered once, by its own best candidates."""
    x = np.random.default_rng(8).integers(-40, 40, (9049, 8))
    table = spark.createDataFrame([(0 if i < 9000 else i, (v / 256).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    got = topk.search(table, F.col("vec_id") == 0)
    scores = x[:9000] @ x[9000:].T
    want = collections.Counter()
    for q in {tuple(v): s for v, s in zip(x[:9000].tolist(), scores, strict=True)}.values():
        best = np.lexsort((np.arange(49), -q))[:5]
        want.update((k + 1, int(9000 + i), int(q[i])) for k, i in enumerate(best))
    assert collections.Counter((r["rank"], r.vec_id, r.score) for r in got.collect()) == want


# --- op8 --------------------------------------------------------------------------------------------------------

def shingles(t):
    w = "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())


def brute_links(texts):
    s = [shingles(t) for t in texts]
    near = [[j for j in range(len(s)) if j != i and s[i] and 5 * len(s[i] & s[j]) >= 4 * len(s[i] | s[j])] for i in range(len(s))]
    group = list(range(len(s)))
    for _ in s:
        for i, js in enumerate(near):
            for j in js:
                group[i] = group[j] = min(group[i], group[j])
    return [len(js) for js in near], group


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(21)
    out = []
    for _ in range(6):
        base = words(rng, 120).split()
        for _ in range(12):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = words(rng, 1)
            out.append(" ".join(w).capitalize())
    return [*out, out[0], out[0].upper(), *(words(rng, 50) for _ in range(30)), "a b c", "A, b. c!", None, "", "!?", words(rng, 4000)]


def test_links(spark, copies, monkeypatch):
    links, group = brute_links(copies)
    for tiles in ((1024, 256), (8, 4)):
        monkeypatch.setattr(jaccard, "TILE", tiles[0])
        monkeypatch.setattr(jaccard, "SET_TILE", tiles[1])
        got = {r.doc: r for r in jaccard.near_duplicates(frame(spark, copies)).collect()}
        assert [got[i].n_links for i in range(len(copies))] == links
        assert [got[i].class_id for i in range(len(copies))] == group
        assert all(got[i].class_size == max(1, group.count(group[i])) for i in got)


def test_one_of_each_group_stays(spark, copies, odd, empty):
    _, group = brute_links(copies)
    kept = jaccard.keep_one(frame(spark, copies))
    assert kept.columns == DOCS.replace(",", "").split()[::2]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(group))
    assert rows(jaccard.keep_one(odd), "doc_id") == sorted([(0,), (1,), (2,), (3,), (4,), (6,), (7,), (None,)], key=str)
    assert jaccard.near_duplicates(empty).count() == 0 and jaccard.keep_one(empty).count() == 0


def test_groups_of_one_or_no_doc_id_stay_apart(spark):
    rng = random.Random(34)
    texts = [words(rng, 40) for _ in range(8)]
    for own in (None, 5):
        docs = frame(spark, [*texts, texts[0], texts[1].upper(), texts[2] + " end", texts[3]], [own] * 9 + [7, 8, own])
        kept = [r.text.lower().removesuffix(" end") for r in jaccard.keep_one(docs).collect()]
        assert sorted(kept) == sorted(texts)


# --- op9 --------------------------------------------------------------------------------------------------------

def test_repeated_spans_go(spark, odd, empty):
    rng = random.Random(30)
    sentence = lambda: words(rng, rng.randint(6, 10)).capitalize() + "."
    passage = " ".join(sentence() for _ in range(8))
    clean = [" ".join(sentence() for _ in range(10)) for _ in range(5)]
    one = sentence()
    texts = [clean[0] + "\n" + passage + "\n" + clean[1], passage + " " + clean[2], clean[3] + " half a sentence " + passage.upper() + " and so on", clean[4] + " " + one, one + " " + sentence(), passage + " " + passage, ("x" + words(rng, 90) + " ") * 2]
    got = {r.doc_id: r for r in spans.remove_repeated(frame(spark, texts)).collect()}
    assert got[0].text == texts[0] and got[0]["__removed"] == 0  # the first stays
    assert got[1].text == clean[2] and got[1]["__spans"] == 1
    assert got[2].text.startswith(clean[3]) and passage.upper()[100:300] not in got[2].text and got[2].text.endswith("and so on")
    assert got[3].text == texts[3] and got[4].text == texts[4]  # a single common sentence is no span
    assert got[5].text == "" and len(got[6].text) < 0.6 * len(texts[6])
    cut = spans.remove_repeated(odd)
    assert cut.columns == [*odd.columns, "__removed", "__spans"]
    assert rows(cut, "doc_id", "text") == rows(odd, "doc_id", "text")
    assert spans.remove_repeated(empty).count() == 0


def test_a_repeated_span_may_be_in_one_document(spark):
    rng = random.Random(31)
    p = " ".join(words(rng, 9).capitalize() + "." for _ in range(4))
    got = spans.remove_repeated(frame(spark, [p + " " + words(rng, 9) + ". " + p, p + " " + p, p + " " + p], [7, 7, 7])).collect()
    # Texts of one doc_id remove from each other too; equal rows are treated alike.
    assert sorted(r.text.count(p[:60]) for r in got) in ([0, 0, 1], [0, 1, 1])


def plain_words(t):
    return re.findall(r"[a-z0-9]+", t.lower())


def brute_spans(texts, ids, marks):
    """The words that stay of every text: runs of sentences and picked runs of words, compared word by word."""
    places = collections.defaultdict(list)
    for d, t in enumerate(texts):
        parts = [plain_words(x) for x in re.split(r"(?<=[.!?])\s|\n", t)]
        parts = [x for x in parts if x]
        assert all(len(x) <= spans.LONG for x in parts)
        flat, edge = [w for x in parts for w in x], [0]
        for x in parts:
            edge.append(edge[-1] + len(x))
        runs = set()
        for i in range(len(parts)):
            to = next((j for j in range(i + 2, len(parts) + 1) if edge[j] - edge[i] >= 16), None)
            back = next((j for j in range(i - 1, -1, -1) if edge[i + 1] - edge[j] >= 16), None)
            runs |= {(edge[i], edge[to], True)} if to else set()
            runs |= {(edge[back], edge[i + 1], True)} if back is not None else set()
        batch = Batch(encoded([t]))
        h = [int(batch.runs(np.array([k]), np.array([k + spans.GRAM]))[0]) for k in range(len(flat) - spans.GRAM + 1)]
        for k in range(len(h) - spans.PICK + 1):
            least = min(h[k : k + spans.PICK])
            runs |= {(j, j + spans.GRAM, False) for j in range(k, k + spans.PICK) if h[j] == least}
        for a, b, whole in runs:
            places[tuple(flat[a:b])].append((d, a, b, whole))
    order = {d: (ids[d], marks[texts[d]]) for d in range(len(texts))}
    gone = [set() for _ in texts]
    for found in places.values():
        found.sort(key=lambda f: (order[f[0]], f[1]))
        lead = {}
        for d, a, b, whole in found:
            first = lead.setdefault(d, (a, b))
            if order[d] > order[found[0][0]] or (a > first[0] and (whole or a >= first[1])):
                gone[d].update(range(a, b))
    return [[w for k, w in enumerate(plain_words(t)) if k not in g] for t, g in zip(texts, gone, strict=True)]


def test_spans_against_brute_force(spark):
    rng = random.Random(36)
    pool = [words(rng, rng.randint(1, 14)).capitalize() + rng.choice(".!?") for _ in range(60)]
    passages = [words(rng, 70) for _ in range(4)]
    texts = []
    for _ in range(50):
        t = []
        for _ in range(rng.randint(1, 6)):
            k = rng.randrange(50)
            t += pool[k : k + rng.randint(1, 5)]
            if rng.random() < 0.3:
                w = rng.choice(passages).split()
                w = w[rng.randint(0, 10) : rng.randint(50, 70)]
                t += [" ".join(w[i : i + 20]) + "." for i in range(0, len(w), 20)]
        texts.append(rng.choice([" ", "\n"]).join(t))
    ids = [rng.randrange(40) for _ in texts]
    marks = {r.t: r.m for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.xxhash64("t").alias("m")).collect()}
    got = collections.defaultdict(list)
    for r in spans.remove_repeated(frame(spark, texts, ids).withColumn("number", F.monotonically_increasing_id())).collect():
        got[r.doc_id].append(plain_words(r.text))
    want = collections.defaultdict(list)
    for i, w in zip(ids, brute_spans(texts, ids, marks), strict=True):
        want[i].append(w)
    assert {i: sorted(w) for i, w in got.items()} == {i: sorted(w) for i, w in want.items()}
    assert sum(map(len, [w for v in want.values() for w in v])) < 0.6 * sum(len(plain_words(t)) for t in texts)


def test_a_repeated_passage_may_begin_and_end_inside_sentences(spark):
    rng = random.Random(32)
    a, b, c, d = (words(rng, n) for n in (29, 31, 30, 30))
    passage = " ".join(a.split()[9:]) + ". " + b + ". " + " ".join(c.split()[:20])
    texts = [f"{words(rng, 9)} {passage} {words(rng, 9)}.", f"{words(rng, 7)} {passage.replace('.', '.&&&').upper()} {words(rng, 8)}.", f"{d} {words(rng, 40)}."]
    got = {r.doc_id: r for r in spans.remove_repeated(frame(spark, texts)).collect()}
    assert got[0].text == texts[0] and got[2].text == texts[2]
    assert len(got[1].text.split()) <= 15 + 2 * (spans.PICK - 1) and texts[1].startswith(got[1].text[:30]) and got[1].text[-30:] == texts[1][-30:]


def test_closing_short_sentences_of_a_passage_go(spark):
    rng = random.Random(33)
    passage = " ".join(words(rng, n).capitalize() + "." for n in (12, 12, 9, 4))
    texts = [passage, words(rng, 9) + ". " + passage + " " + words(rng, 25) + ".", words(rng, 12) + ". " + passage]
    got = {r.doc_id: r for r in spans.remove_repeated(frame(spark, texts)).collect()}
    assert [got[i].text.strip() for i in range(3)] == [t if i == 0 else t.replace(passage, "").replace("  ", " ").strip() for i, t in enumerate(texts)]


def test_texts_without_doc_id_remove_from_each_other(spark):
    rng = random.Random(35)
    passage = " ".join(words(rng, 9).capitalize() + "." for _ in range(5))
    ends = [words(rng, 12) + "." for _ in range(3)]
    got = [r.text for r in spans.remove_repeated(frame(spark, [e + " " + passage for e in ends], [None, None, 3])).collect()]
    assert sum(passage in t for t in got) == 1 and all(sum(t.startswith(e) for t in got) == 1 for e in ends)
    assert next(t for t in got if t.startswith(ends[2])).strip() == ends[2]


# --- op10 -------------------------------------------------------------------------------------------------------

def test_leaks(spark, odd, empty):
    rng = random.Random(40)
    items = [words(rng, 40) for _ in range(12)]
    bench = spark.createDataFrame([*((i, t) for i, t in enumerate(items)), (90, None), (91, "x"), (92, items[0])], "item_id long, text string")
    turned = items[5].split()
    texts = [words(rng, 100) + " " + items[3] + " " + words(rng, 50), " ".join(turned[20:] + ["z"] + turned[:20]), " ".join(items[7].split()[:12]), items[0].title(), words(rng, 300), None, ""]
    for block in (16 << 20, 300):
        got = {r.doc_id: [x.item_id for x in r.leaks] for r in decontamination.find_leaks(frame(spark, texts), bench, block_bytes=block).collect()}
        assert {k: sorted(v) for k, v in got.items()} == {0: [3], 1: [5], 2: [], 3: [0, 92], 4: [], 5: [], 6: []}
    assert {r.leaks == [] for r in decontamination.find_leaks(odd, bench).collect()} == {True}
    assert {r.leaks == [] for r in decontamination.find_leaks(odd, bench.limit(0)).collect()} == {True}
    assert decontamination.find_leaks(empty, bench).count() == 0


# --- pipeline ---------------------------------------------------------------------------------------------------

def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(50)
    sentence = lambda: words(rng, 9).capitalize() + "."
    body = lambda n=12: " ".join(sentence() for _ in range(n))
    item, passage = words(rng, 40), body(8)
    texts = [body() for _ in range(300)]
    for i in range(0, 180, 3):
        texts[i] += " awfulword nastyterm awfulword"
    texts[200] = texts[201]
    texts[203] = texts[202].replace(texts[202].split()[5], "changed")
    texts[210] += " " + passage
    texts[211] = passage + " " + texts[211]
    texts[212] += " " + item
    texts += [None, ""]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(180)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    gone = set(range(0, 180, 3)) | {201, 203, 212}
    assert set(out) == set(range(302)) - gone
    assert passage in out[210].text and passage not in out[211].text and out[211].n_chars == len(out[211].text)
    assert out[300].text is None and out[300].n_tokens == 0 and out[5].decoded_sha256 == hashlib.sha256(texts[5].encode()).hexdigest()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "substring_dedup", "benchmark_decontamination", "bpe_encoding"]


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    """Every stage on what the one before it kept, held against brute force."""
    import corpus_pipeline

    from tests.llm.test_plain import brute_features, brute_tiles

    rng = random.Random(51)
    sentence = lambda: words(rng, rng.randint(4, 12)).capitalize() + "."
    pool = [" ".join(sentence() for _ in range(rng.randint(3, 6))) for _ in range(12)]
    items = [words(rng, 30) for _ in range(6)]
    texts = []
    for i in range(90):
        t = " ".join([*(sentence() for _ in range(rng.randint(4, 9))), *rng.sample(pool, rng.randint(0, 2))])
        t += f" {rng.choice(items)}" if i % 11 == 0 else ""
        texts.append(t + (" awfulword nastyterm awfulwords." if i % 4 == 0 else ""))
    texts += [texts[1], texts[2].replace(texts[2].split()[3], "other"), None, "", "!?"]
    docs = frame(spark, texts)
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = {}

    def step(name, docs):
        out = stages[name](spark, docs, str(tmp_path)).cache()
        assert out.columns[: len(DOCS.split(", "))] == [c.split()[0] for c in DOCS.split(", ")]
        kept.update({name: {r.doc_id: r for r in out.collect()}})
        return out

    now = step("toxicity", docs)
    model = toxicity.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    scores = model.score([brute_features(t, model.words, model.stems, model.discounts) for t in texts])
    assert set(kept["toxicity"]) == {i for i, s in enumerate(scores) if s < toxicity.THRESHOLD} and len(kept["toxicity"]) < len(texts)
    now, left = step("ngram_jaccard_join", now), sorted(kept["toxicity"])
    _, group = brute_links([texts[i] for i in left])
    assert set(kept["ngram_jaccard_join"]) == {left[g] for g in group} and len(kept["ngram_jaccard_join"]) < len(left)
    now, left = step("substring_dedup", now), sorted(kept["ngram_jaccard_join"])
    marks = {r.t: r.m for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.xxhash64("t").alias("m")).collect()}
    want = dict(zip([i for i in left if texts[i]], brute_spans([texts[i] for i in left if texts[i]], [i for i in left if texts[i]], marks), strict=True))
    cut = {i: r.text for i, r in kept["substring_dedup"].items()}
    assert set(cut) == set(left) and all(plain_words(cut[i] or "") == want.get(i, []) for i in left) and any(len(w) < len(plain_words(texts[i])) for i, w in want.items())
    now = step("benchmark_decontamination", now)
    leaked = lambda t: any(2 * sum(x[2] for x in brute_tiles(plain_words(t or ""), plain_words(item), 6)) >= len(plain_words(item)) for item in items)
    assert set(kept["benchmark_decontamination"]) == {i for i, t in cut.items() if not leaked(t)} and len(kept["benchmark_decontamination"]) < len(cut)
    step("bpe_encoding", now)
    codec = tokens.Codec(open(vocabulary_path(), encoding="utf-8").read())
    for r in kept["bpe_encoding"].values():
        ids = codec.tokenizer.encode(r.text or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_pipeline_of_an_empty_table_and_odd_rows(spark, odd, empty, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(4, 1, 0), (7, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, None), (1, "never said here at all by anyone")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    helpers = ["leaks", "row", "doc", "own", "mark", "__removed", "__spans", "Removed", "spans", "coded", "passes", "tid"]
    for docs, n in ((odd, 8), (empty, 0)):
        for c in helpers:
            docs = docs.withColumn(c, F.lit(7))
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
        rows_ = docs.collect()
        assert len(rows_) == n and all(r[c] == 7 for r in rows_ for c in helpers) and all(r.key is None and r.shard == 3 for r in rows_)
