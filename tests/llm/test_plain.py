"""The operators' inner parts against brute force, without Spark."""

import collections
import dataclasses
import hashlib
import math
import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenlake.llm import decontamination, jaccard, lpf, quality, spans, tokens, topk, toxicity, warc
from lumenlake.llm.bytewords import Batch, encoded
from lumenlake.llm.queries import vocabulary_path

WORDS = "the of and to in is that it was for on are as with his they at be this from have or by one had not but what all were".split()


def text(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 50)) for _ in range(n))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abcd", min_size=1, max_size=8))
def test_automaton_is_levenshtein(term):
    words = ["abcda", "bcdab", "abc", "ddddd", "cab"]
    want = 1 if term in words else 2 if any(len(w) >= 5 and distance(term, w) == 1 for w in words) else 0
    assert toxicity.Lexicon(words, []).match(term) == want


def test_automaton_reads_stems_and_lookalikes():
    lexicon = toxicity.Lexicon(["stupid"], ["achlich"])
    assert [lexicon.match(t) for t in ("stupid", "stup1d", "stuppid", "studid", "stpid", "stpd", "achlicher", "achliche", "achlic")] == [1, 1, 2, 2, 2, 0, 3, 3, 0]


def test_stems_and_short_words_allow_an_edit():
    lexicon = toxicity.Lexicon(["scum", "foolishly", "st0pit"], ["foolish"], short=True)
    assert [lexicon.match(t) for t in ("foolishness", "fooolishness", "fo0lishness", "foelishness", "foolishly", "foelishly", "foolis", "foxishing")] == [3, 2, 3, 2, 3, 2, 0, 0]
    assert [lexicon.match(t) for t in ("scum", "skum", "skumm", "st0pit", "stopit", "st0ppit")] == [1, 4, 0, 1, 1, 2]
    rng = random.Random(4)
    rows = [(text(rng, 40) + (f" gr0bnak{rng.choice(['ly', 'ity', 'ness'])}" if i % 5 == 0 else ""), int(i % 5 == 0)) for i in range(400)]
    model = toxicity.fit(rows)
    s = model.score([toxicity.Scanner(toxicity.Lexicon(model.words, model.stems, short=True)).features(t) for t in ("some fine words here", "some fine gr0bnakly here", "some fine grobnakness here")])
    assert s[0] < 0.5 < s[1] == s[2] and any("grobnakly".startswith(t) for t in model.stems) and "grobnakly" in model.words


def test_quotation_weighs_less_than_abuse():
    scanner = toxicity.Scanner(toxicity.Lexicon(["moron"], []))
    plain, quoted = scanner.features("you are a moron today"), scanner.features('he said "what a moron" and left')
    assert plain[0] > quoted[0] > 0 and plain[-1] > quoted[-1]
    assert scanner.features(None) == scanner.features("") and scanner.features("fine words")[0] == 0


def test_toxicity_learns_and_degenerates():
    rng = random.Random(3)
    rows = [(text(rng, 40) + (" scumbag loser" if i % 5 == 0 else ""), int(i % 5 == 0)) for i in range(400)]
    model = toxicity.fit(rows)
    assert {"scumbag", "loser"} <= set(model.words)
    s = model.score([toxicity.Scanner(toxicity.Lexicon(model.words, model.stems)).features(t) for t in ("some fine words here", "some fine scumbag loser here", "")])
    assert s[0] < 0.5 < s[1] and 0 <= s[2] < 0.5
    assert toxicity.fit([]).score([[0.0]]).tolist() == [0] and toxicity.fit([("a", 0)]).score([[0.0]]).tolist() == [0]


def test_network_learns_and_scores_whole_texts():
    rng = random.Random(5)
    rows = [(text(rng, 60), 1) if i % 2 else (text(rng, 60).replace(" ", "&& "), 0) for i in range(200)]
    scorer = quality.Scorer(quality.fit(rows, epochs=6))
    good, bad = text(rng, 80), text(rng, 80).replace(" ", "&& ")
    s = scorer.score([good, bad, "", None, good])
    assert s[0] > 0.5 > s[1] and s[2] == s[3] and s[0] == s[4] and (0 <= s).all() and (s <= 1).all()
    late = text(rng, 3000)
    assert scorer.score([late + " && && " * 400])[0] < scorer.score([late])[0]  # the end of a long text counts
    assert quality.Scorer(quality.fit([])).score(["x"]).tolist() == [0.5]


def test_network_gradient():
    rng = np.random.default_rng(1)
    w = {"f": rng.normal(0, 0.3, (4, 256, quality.FILTERS)), "d": rng.normal(0, 0.3, (2 * quality.FILTERS, quality.HIDDEN)), "db": np.zeros(quality.HIDDEN), "o": rng.normal(0, 0.3, quality.HIDDEN), "ob": np.zeros(1)}
    docs, y = [quality.blocks("some words " * 40), quality.blocks("other && words && " * 30)], np.array([1.0, 0.0])

    def loss(f):
        net = quality.Network(f, w["d"], w["db"], w["o"], 0.0)
        x = np.zeros((2, 2 * quality.FILTERS))
        for i, d in enumerate(docs):
            chunk = np.maximum(quality._halves(quality._responses(d, quality._tables(f)).max(axis=1)), 0)
            x[i] = np.concatenate([chunk.max(0), chunk.mean(0)])
        p = quality._combine(net, x)
        return -float((y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    g = quality._gradients(w, docs, y)["f"]
    k, byte, unit = np.unravel_index(np.abs(g).argmax(), g.shape)
    moved = [w["f"].copy(), w["f"].copy()]
    moved[0][k, byte, unit] += 1e-5
    moved[1][k, byte, unit] -= 1e-5
    assert (loss(moved[0]) - loss(moved[1])) / 2e-5 == pytest.approx(g[k, byte, unit], rel=1e-3)


@pytest.fixture(scope="module")
def codec():
    with open(vocabulary_path(), encoding="utf-8") as f:
        return tokens.Codec(f.read())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab cé'\n.1 \trsll日 　“¾<|>"), max_size=400) | st.text(max_size=60) | st.just("a b<|endoftext|> c d" * 9), max_size=4))
def test_codec_equals_library(codec, texts):
    want = []
    for ids in (codec.tokenizer.encode(t, add_special_tokens=False).ids for t in texts):
        back = codec.tokenizer.decode(ids, skip_special_tokens=False)
        want.append((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert codec.run(texts, mean=24, least=8, most=64) == want


def test_codec_reuses_shared_chunks(codec):
    rng = random.Random(8)
    shared = text(rng, 4000)
    before = codec.reused
    codec.run([shared])
    codec.run([text(rng, 300) + " " + shared])
    assert codec.reused > before


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(min_codepoint=9, max_codepoint=255, exclude_categories=()), max_size=80) | st.text(st.sampled_from("ab'sltredvm 1\n\t\r.é"), max_size=60))
def test_both_libraries_agree_on_plain_texts(codec, t):
    if tokens._PLAIN.match(t):
        ids = codec.fast.encode_ordinary(t)
        assert ids == codec.tokenizer.encode(t, add_special_tokens=False).ids and codec.fast.decode_bytes(ids).decode() == codec.tokenizer.decode(ids, skip_special_tokens=False)


def test_joins_are_compared_and_other_tokenizers_encode_whole(codec):
    import json

    import public_tokenizers

    rng = random.Random(18)
    texts = [text(rng, 3000), "今天天气很好，我们去公园。" * 300, "x" * 30000, text(rng, 500)]
    joins, whole = codec.joins, codec.whole
    codec.run(texts)
    assert codec.joins - joins > 10 and codec.whole == whole
    # A word that a neighbour changes: the ids disagree and the text is encoded as a whole.
    spoiled = tokens.Codec(codec.tokenizer.to_str())
    spoiled._insides = lambda new: {t: dataclasses.replace(c, first=[1]) for t, c in tokens.Codec._insides(spoiled, new).items()}
    assert spoiled.run(texts) == codec.run(texts) and spoiled.whole >= 2
    for name, fits in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        with open(public_tokenizers.path(name), encoding="utf-8") as f:
            spec = f.read()
        assert tokens.parts_at_blanks(json.loads(spec)) is fits
        swapped = json.loads(spec)
        swapped["model"]["merges"][3:5] = swapped["model"]["merges"][4:2:-1]
        assert tokens.ranked(swapped) is None
        other = tokens.Codec(spec)
        want = [other.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert [(n, i) for n, i, _ in other.run(texts)] == [(len(i), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest()) for i in want]


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=3000))
def test_cuts_are_whole_and_bounded(raw):
    data = np.frombuffer(raw.decode("utf-8", "replace").encode(), np.uint8)
    at = [0, *tokens.cuts(data, mean=64, least=16, most=128), len(data)]
    assert at == sorted(set(at)) or len(data) == 0
    assert all(data[a] & 0xC0 != 0x80 for a in at[1:-1]) and all(b - a <= 132 for a, b in zip(at, at[1:], strict=False))


def test_words_of_a_batch():
    texts = ["Ünser Haus, 2 häuser!", "", "ein HAUS", "haus"]
    b = Batch(encoded(texts))
    assert [b.data[s:e].tobytes().decode() for s, e in zip(b.start, b.end, strict=True)] == ["Ünser", "Haus", "2", "häuser", "ein", "HAUS", "haus"]
    assert b.word[1] == b.word[5] == b.word[6] and len(set(b.word.tolist())) == 5
    assert Batch(encoded(["ünser"])).word[0] == b.word[0]


def test_words_of_any_script():
    texts = ["“Ünser”\u00a0Haus — l’été…", "今天天气，很好。ok好", "नमस्ते दुनिया।", "ไทย", "e\u0301te\u0301 😀 x", '"ünser" haus - l\'été...']
    b = Batch(encoded(texts))
    got = [b.data[s:e].tobytes().decode() for s, e in zip(b.start, b.end, strict=True)]
    assert [got[x:y] for x, y in zip(b.first[:-1], b.first[1:], strict=True)] == [
        ["Ünser", "Haus", "l", "été"], [*"今天天气很好", "ok", "好"], ["नमस्ते", "दुनिया"], [*"ไทย"], ["e\u0301te\u0301", "x"], ["ünser", "haus", "l", "été"]]
    assert b.word[: b.first[1]].tolist() == b.word[b.first[5] :].tolist()
    items = decontamination.Items([1], ["今天天气很好，我们去公园散步吧。"], 6)
    assert list(items.leaks(Batch(encoded(["他说：今天天气很好，我们去公园散步吧。然后走了", "别的句子在这里没有重复的内容"])), 0.5)) == [0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=12), min_size=2, max_size=6))
def test_shingles_are_sets_of_runs(docs):
    texts = [" ".join(f"w{x}" for x in d) for d in docs]
    batch = Batch(encoded(texts))
    text_, h = batch.shingles(5)
    got = [set(h[text_ == i].tolist()) for i in range(len(docs))]
    runs = [{tuple(d[k : k + 5]) for k in range(len(d) - 4)} or ({tuple(d)} if d else set()) for d in docs]
    assert all((got[i] == got[j]) == (runs[i] == runs[j]) and len(got[i] & got[j]) == len(runs[i] & runs[j]) for i in range(len(docs)) for j in range(len(docs)))


def test_bayesian_pruning_keeps_what_reaches_the_threshold():
    assert jaccard.least_matches(32) < 0.8 * 32 and jaccard.least_matches(128) > 64
    rng = random.Random(4)
    base = text(rng, 300).split()
    docs = [base] + [[w if rng.random() > rate else "x" + w for w in base] for rate in (0.005, 0.01, 0.02, 0.03, 0.1, 0.5) for _ in range(6)]
    _, _, sets, values = jaccard.signatures(Batch(encoded([" ".join(d) for d in docs])))
    i, j = jaccard.surviving(values, values)
    pairs = set(zip(i.tolist(), j.tolist(), strict=True))
    plain = [set(s.tolist()) for s in sets]
    similar = {(a, b) for a in range(len(docs)) for b in range(len(docs)) if 5 * len(plain[a] & plain[b]) >= 4 * len(plain[a] | plain[b])}
    assert similar <= pairs and len(pairs) < len(docs) ** 2
    good = jaccard.verified(sets, sets, i, j)
    assert {(a, b) for a, b, g in zip(i.tolist(), j.tolist(), good, strict=True) if g} == similar
    few = jaccard.verified(sets, sets, i[:5], j[:5])
    assert few.tolist() == good[:5].tolist()


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=30))
def test_longest_factors(s):
    n = len(s)
    order = sorted(range(n), key=lambda i: s[i:])
    common = lambda a, b: next((k for k in range(n - max(a, b)) if s[a + k] != s[b + k]), n - max(a, b))
    lcp = [0] + [common(a, b) for a, b in zip(order, order[1:], strict=False)]
    before, after = lpf.longest_factors(order, lcp)
    assert before == [max((common(i, j) for j in range(i)), default=0) for i in range(n)]
    assert after == [max((common(i, j) for j in range(i + 1, n)), default=0) for i in range(n)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=60), min_size=1, max_size=5), st.integers(0, 3))
def test_chunks_bring_equal_strings_together(texts, seed):
    rng, length = random.Random(seed), 12
    texts = [bytes(b % 3 for b in t) for t in texts] + [bytes(rng.randrange(3) for _ in range(40))]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    text_, key, first, places, _, recurs = lpf.chunks(np.frombuffer(b"".join(texts), np.uint8), at, length)
    where = collections.defaultdict(list)
    for t, k, f, n, r in zip(text_.tolist(), key.tolist(), first.tolist(), places.tolist(), recurs.tolist(), strict=True):
        for p in range(f, f + n):
            where[texts[t][p : p + length]].append((t, f, k, r))
    assert sum(map(len, where.values())) == sum(max(0, len(t) - length + 1) for t in texts)
    for found in where.values():
        assert len({k for _, _, k, _ in found}) == 1
        if len(found) > 1 and len({(t, f) for t, f, _, _ in found}) == 1:
            assert found[0][3]  # repeats inside one chunk are announced


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=12, max_size=60))
def test_suffix_order_has_true_common_prefixes(values):
    data, n = np.array(values, np.uint8), 10
    place = np.arange(len(data) - n + 1)
    order, lcp = lpf.suffix_order(data, place, n)
    strings = [bytes(values[p : p + n]) for p in range(len(place))]
    assert order == sorted(range(len(place)), key=strings.__getitem__)
    common = lambda a, b: next((k for k in range(n) if a[k] != b[k]), n)
    assert lcp == [0] + [common(strings[a], strings[b]) for a, b in zip(order, order[1:], strict=False)]


def test_a_part_of_a_key_is_bounded():
    """Of a key with many kinds a part gets the bytes of its own strings only, and beyond a number of kinds none."""
    rng = random.Random(19)
    body = np.frombuffer(text(rng, 400)[:1500].encode(), np.uint8)
    width = lpf.LENGTH - lpf.GRAM + 1
    for _, key, first, places, _, _ in [tuple(x[k] for x in lpf.chunks(body, np.array([0, len(body)]), lpf.LENGTH)) for k in range(3)]:
        chunk = body[first : first + places - 1 + lpf.LENGTH].tobytes()
        for kinds in (1, 512, 513, 4000, 512 * lpf.PARTS):
            parts, got = lpf.parts_of(kinds, lpf.LENGTH), lpf.dealt(chunk, int(places), int(key), kinds, lpf.LENGTH)
            assert sorted(p for _, a, n, _ in got for p in range(a, a + n)) == list(range(places))
            assert all(piece == chunk[a : a + n - 1 + lpf.LENGTH] for _, a, n, piece in got)
            assert max(n for _, _, n, _ in got) <= -(-width // parts) and kinds * -(-width // parts) <= 1.05 * lpf.KINDS * width + kinds
            assert sum(len(piece) for *_, piece in got) <= len(chunk) + (parts + 1) * lpf.LENGTH
    assert lpf.parts_of(512 * lpf.PARTS + 1, lpf.LENGTH) == 0 and lpf.parts_of(100_000, lpf.LENGTH) == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=50), st.integers(1, 9))
def test_window_minima(values, n):
    x = np.array(values, np.uint64)
    if n <= len(x):
        assert lpf.window_minima(x, n).tolist() == [min(values[i : i + n]) for i in range(len(values) - n + 1)]


def test_covered_spans():
    assert lpf.covered(100, [(50, 2), (0, 1), (10, 5)], 10) == [(0, 24), (50, 61)]
    assert lpf.covered(30, [(25, 9)], 10) == [(25, 30)] and lpf.covered(5, [], 10) == []


def test_tiling_finds_reordered_passages():
    rng = random.Random(2)
    item = [f"w{i}" for i in range(40)]
    moved = [f"x{i}" for i in range(9)] + item[25:] + [f"y{i}" for i in range(5)] + item[:25]
    b = Batch(encoded([" ".join(moved), " ".join(item)]))
    tiles = decontamination.tile(b.word[: b.first[1]], b.word[b.first[1] :], 6)
    assert sorted(t[1:] for t in tiles) == [(0, 25), (25, 15)]
    items = decontamination.Items([7, 8], [" ".join(item), "a b"], 6)
    texts = [" ".join(moved), text(rng, 200), "", " ".join(item[:10]), "W1, " + " ".join(item).upper()]
    found = items.leaks(Batch(encoded(texts)), 0.5)
    assert {d: [x[0] for x in v] for d, v in found.items()} == {0: [7], 4: [7]}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=40), st.lists(st.integers(0, 4), min_size=3, max_size=20))
def test_tiles_are_matches_that_do_not_overlap(doc, item):
    d, i = (np.array([hash((x, "w")) & (2**63 - 1) for x in v], np.uint64) for v in (doc, item))
    tiles = decontamination.tile(d, i, 3)
    used_d, used_i = set(), set()
    for a, b, n in tiles:
        assert n >= 3 and doc[a : a + n] == item[b : b + n]
        assert used_d.isdisjoint(range(a, a + n)) and used_i.isdisjoint(range(b, b + n))
        used_d |= set(range(a, a + n))
        used_i |= set(range(b, b + n))
    left = lambda a, b: all(a + k not in used_d and b + k not in used_i for k in range(3))
    assert not any(doc[a : a + 3] == item[b : b + 3] and left(a, b) for a in range(len(doc) - 2) for b in range(len(item) - 2))


def brute_tiles(doc, item, least):
    """Longest common stretch of unmarked words first, by all places."""
    doc_free, item_free, tiles = [True] * len(doc), [True] * len(item), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and item_free[i + n] and doc_free[d + n]:
                    n += 1
                best = min(best, (-n, i, d))
        n, i, d = -best[0], best[1], best[2]
        if n < least:
            return tiles
        doc_free[d : d + n], item_free[i : i + n] = [False] * n, [False] * n
        tiles.append((d, i, n))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.lists(st.integers(0, 3), min_size=1, max_size=24))
def test_tiles_against_brute_force(doc, item):
    d, i = (np.array([hash((x, "w")) & (2**63 - 1) for x in v], np.uint64) for v in (doc, item))
    assert decontamination.tile(d, i, min(3, len(item))) == brute_tiles(doc, item, min(3, len(item)))


def test_leaks_against_brute_force():
    rng = random.Random(20)
    phrase = [f"p{k}" for k in range(9)]  # in every item
    items = [[f"i{rng.randrange(60)}" for _ in range(rng.randint(0, 12))] + phrase + [f"i{rng.randrange(60)}" for _ in range(rng.randint(0, 12))] for _ in range(40)] + [["one"], ["two", "words"], [], ["i1", "i2", "i3", "i4"]]
    docs = [sum((rng.choice(items)[rng.randint(0, 9) : rng.randint(10, 30)] + [f"d{rng.randrange(9)}"] for _ in range(rng.randint(0, 4))), []) for _ in range(60)]
    index = decontamination.Items(list(range(len(items))), [" ".join(x) for x in items], 6)
    assert len(index.table[6][0]) < sum(max(0, len(x) - 5) for x in items)  # seeds of the phrase are left out
    got = index.leaks(Batch(encoded([" ".join(x) for x in docs])))
    want = {}
    for a, d in enumerate(docs):
        for b, x in enumerate(items):
            tiles = brute_tiles(d, x, min(6, len(x))) if x else []
            if x and 2 * sum(t[2] for t in tiles) >= len(x):
                want.setdefault(a, []).append((b, sum(t[2] for t in tiles) / len(x), len(tiles)))
    assert got == want and sum(map(len, want.values())) > 30


def test_sentences_cover_the_text():
    texts = ["One two. Three 3.14 four!\nFive", "", "  . ", "a " * 200, "ends. "]
    s = spans.Sentences(Batch(encoded(texts)))
    data = s.batch.data.tobytes()
    assert [data[a:b].decode() for a, b in zip(s.start, s.end, strict=True)][:3] == ["One two. ", "Three 3.14 four!\n", "Five"]
    for t, body in enumerate(texts):
        own = s.text == t
        if own.any():
            assert b"".join(data[a:b] for a, b in zip(s.start[own], s.end[own], strict=True)).decode() == body


def test_repeated_stretches_have_a_run_in_common():
    rng = random.Random(8)
    for _ in range(40):
        stretch = text(rng, spans.GRAM + spans.PICK - 1)
        batch = Batch(encoded([text(rng, rng.randint(0, 60)) + " " + t + " " + text(rng, rng.randint(0, 60)) for t in (stretch, stretch.replace(" ", "&&. ").upper())]))
        k, h = spans.picked(batch, spans.GRAM)
        assert set(h[k < batch.first[1]].tolist()) & set(h[k >= batch.first[1]].tolist())
    assert not len(spans.picked(Batch(encoded(["a b", ""])), spans.GRAM)[0])


def test_block_top_is_exact():
    rng = np.random.default_rng(6)
    q, c = np.floor(rng.normal(0, 40, (7, 20))), np.floor(rng.normal(0, 40, (50, 20)))
    c[30:] = c[3]  # ties
    q_ids, c_ids = np.arange(7), np.arange(50)[::-1].copy()
    got = topk.block_top(q_ids, q, c_ids, c, 5)
    for i in range(7):
        want = sorted(((int(q[i] @ c[j]), int(c_ids[j])) for j in range(50) if c_ids[j] != q_ids[i]), key=lambda t: (-t[0], t[1]))[:5]
        assert [(s, v) for k, v, s in got if k == i] == want
    huge = topk.block_top(np.array([0]), np.array([[2.0**40, 1.0]]), np.array([1, 2]), np.array([[2.0**20, 3.0], [2.0**20, 4.0]]), 1)
    assert huge == [(0, 2, 2**60 + 4)]


def test_segment_bound_is_a_bound():
    rng = np.random.default_rng(7)
    a, b = rng.normal(0, 1, (30, 13)), rng.normal(0, 1, (40, 13))
    for n in topk.LEVELS:
        assert (topk._segments(a, n) @ topk._segments(b, n).T >= a @ b.T - 1e-9).all()


def test_warc_records_round_trip():
    raw = warc.record(5, "http://a.b/\r\nX: y", "é<p>".encode() * 40, "0" * 64, 3)
    fields, payload = warc.parse(raw)
    assert fields["WARC-Type"] == "revisit" and fields["X-Refers-To-Page"] == "3" and payload == b"" and "\r" not in fields["WARC-Target-URI"]
    body = b"x\r\n\r\ny"
    fields, payload = warc.parse(warc.record(None, None, body, hashlib.sha256(body).hexdigest(), None))
    assert payload == body and fields["WARC-Type"] == "response" and fields["X-Page-Id"] == "" and fields["WARC-Target-URI"] == ""
    with pytest.raises(ValueError):
        warc.parse(warc.record(1, "u", body, "0" * 64, None))


def test_exact_scores_are_for_survivors_only():
    rng = np.random.default_rng(16)
    centres = np.cumsum(rng.normal(0, 30, (40, 64)), axis=1)
    structured = np.floor(centres[rng.integers(0, 40, 3000)] + rng.normal(0, 2, (3000, 64)))
    for values, most in ((structured, 0.05), (np.floor(256 * (r := rng.normal(0, 1, (3000, 64))) / np.linalg.norm(r, axis=1, keepdims=True)), 0.6)):
        q, best, seen = topk.Block(np.arange(100), values[:100]), topk.Best(100, 5), collections.Counter()
        for at in range(0, 3000, 1000):
            topk.compare(q, topk.Block(np.arange(at, at + 1000), values[at : at + 1000]), best, seen)
        scores = values[:100] @ values.T
        scores[np.arange(100), np.arange(100)] = -np.inf
        want = [sorted(((-int(s), i) for i, s in enumerate(row) if s > -np.inf))[:5] for row in scores]
        assert [[(-s, v) for k, v, s in best.rows() if k == i] for i in range(100)] == want
        assert seen["pairs"] == 300_000 and seen["scored"] <= most * seen["pairs"] and seen["after level 4"] >= seen["after level 16"] >= seen["after level 32"]


def test_only_large_vectors_leave_doubles():
    rng = np.random.default_rng(17)
    x = np.floor(rng.normal(0, 40, (60, 8)))
    x[5], x[6, 0], x[7] = 2.0**60, -(2.0**45), 0
    got = topk.block_top(np.arange(9), x[:9], np.arange(60), x, 4)
    for i in range(9):
        score = lambda j: max(-(2**63), min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(x[i], x[j], strict=True))))
        want = sorted(((-score(j), j) for j in range(60) if j != i))[:4]
        assert [(-s, v) for k, v, s in got if k == i] == want


def folded(t):
    return "".join(toxicity.LOOKALIKES.get(c, c) for c in t)


def terms_by_hand(low):
    """(term, start, end): runs of word characters and of signs between them; signs at an end stay if they touch a letter."""
    word, out, i = [c == "_" or c.isalnum() for c in low], [], 0
    while i < len(low):
        if not (word[i] or low[i] in "@$"):
            i += 1
            continue
        j = i
        while j < len(low) and (word[j] or low[j] in "@$"):
            j += 1
        a, b = i, j
        while a < b and not word[a]:
            a += 1
        while b > a and not word[b - 1]:
            b -= 1
        if a < b:
            out.append((low[(first := i if low[a].isalpha() else a) : (last := j if low[b - 1].isalpha() else b)], first, last))
        i = j
    return out


def brute_kind(term, words, stems):
    """The kind of match of a term, with the signs at its ends and without, by edit distances alone."""
    kinds = {brute_match(t, words, stems) for t in (term, term.strip("@$"))}
    return next(k for k in (1, 3, 2, 4, 0) if k in kinds)


def brute_match(term, words, stems):
    t = folded(term)
    if any(t.startswith(folded(s)) for s in stems):
        return 3
    if t in map(folded, words):
        return 1
    kind = lambda x: 2 if len(x) >= toxicity.TOLERANT else 4 if len(x) >= toxicity.SHORT else 0
    near = {kind(w) for w in words if distance(t, folded(w)) == 1}
    near |= {kind(s) for s in stems for k in range(1, len(t) + 1) if t[k - 1] == folded(s)[-1] and distance(t[: k - 1], folded(s)[:-1]) == 1}
    return min(near - {0}, default=0)


def brute_features(body, words, stems, discounts):
    low = (body or "").lower()
    spots = terms_by_hand(low)
    quotes = [i for i, c in enumerate(low) if c in "\"“”„«»"]
    weight, distinct, apart, address = dict.fromkeys(toxicity.KINDS, 0.0), {k: set() for k in toxicity.KINDS}, [0, 0, 0, 0], 0.0
    for i, (t, a, b) in enumerate(spots):
        if not (kind := brute_kind(t, words, stems)):
            continue
        around = spots[max(0, i - toxicity.CONTEXT) : i + toxicity.CONTEXT + 1]
        quoted = any(around[0][1] - 2 <= q < a for q in quotes) and any(b <= q <= around[-1][2] + 2 for q in quotes)
        reported = any(w in toxicity.REPORTING for w, _, _ in around)
        w = (discounts[0] if quoted else 1.0) * (discounts[1] if reported else 1.0)
        weight[kind] += w
        distinct[kind].add(t)
        apart[quoted + 2 * reported] += 1
        address += w if any(x in toxicity.ADDRESS for x, _, _ in around) else 0
    n = len(spots)
    return [x for k in toxicity.KINDS for x in (math.log1p(weight[k]), math.log1p(len(distinct[k])), 100 * weight[k] / (n + 20))] + [math.log1p(n), *(math.log1p(c) for c in apart[1:]), math.log1p(address)]


def test_toxicity_scores_against_brute_force():
    rng = random.Random(22)
    words, stems = ["scum", "moron", "h4te", "foolishly", "vile", "bad", "kiss"], ["stup", "foolis"]
    near = [*words, "skum", "mor0n", "hate", "h8te", "viile", "stupidity", "stuupid", "sutpid", "fool1sh", "foxlis", "foolish", "bda", "st", "fooli", "$cum", "@vile", "kiss", "kis$", "kis$$", "ki$$", "$tupid", "$5", "a$", "$_x", "h@te$", "@$"]
    model = toxicity.Model(tuple(words), tuple(stems), (0.1,) * 17, (0.7,) * 17, tuple(0.3 - 0.05 * k for k in range(18)), (0.2, 0.7))
    scanner = toxicity.Scanner(toxicity.Lexicon(model.words, model.stems, short=True))
    for _ in range(60):
        t = " ".join(rng.choice([rng.choice(near), rng.choice(WORDS), rng.choice(["you", "said", '"', "»x«", '"' + rng.choice(near) + '"'])]) for _ in range(rng.randint(0, 60)))
        got, want = scanner.features(t, model.discounts), brute_features(t, words, stems, model.discounts)
        assert got == pytest.approx(want)
        z = model.weights[-1] + sum((x - 0.1) / 0.7 * w for x, w in zip(want, model.weights, strict=False))
        assert model.score([got])[0] == pytest.approx(1 / (1 + math.exp(-z)))


def test_long_texts_of_many_matches_take_little_time():
    scanner = toxicity.Scanner(toxicity.Lexicon(["moron"], []))
    began = time.perf_counter()
    counts = scanner.counts('he said "what a moron" and ' * 30_000)
    assert sum(map(sum, counts.matches)) == 30_000 and time.perf_counter() - began < 5
    scanner.MOST_TERMS = 50
    many = " ".join(f"mor{c}n {d}moron" for c in "abcdefghijklmnopqrstuvwxyzäöüßéàèùç" for d in "ab")
    assert sum(map(sum, scanner.counts(many + " " + " ".join(f"w{i}" for i in range(200))).matches)) > 50  # more than is remembered


def test_signs_at_the_ends_of_terms():
    scanner = toxicity.Scanner(toxicity.Lexicon(["shit", "ass", "kissass"], ["stupid"]))
    kinds = lambda text: [sum(k) for k in scanner.counts(text).matches]
    for exact in ("$hit", "@ss", "as$", "a$$", "kissa$$", "(a$$)", "@shit", "ki$$@$$"):
        assert kinds(f"what a {exact} it is") == [1, 0, 0, 0], exact
    assert kinds("$tup1d") == [0, 0, 1, 0] and kinds("$100 us$ @name 5$ $$") == [0, 0, 0, 0]
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(30)) for _ in range(240)]
    words, _ = toxicity.learn_lexicon([t + (" you a$$hat" if i % 4 == 0 else "") for i, t in enumerate(texts)], [int(i % 4 == 0) for i in range(240)])
    assert "asshat" in words


def test_learned_lookalikes_match_themselves():
    lexicon = toxicity.Lexicon(["h4te", "v1le"], ["sc4m"], short=True)
    assert [lexicon.match(t) for t in ("h4te", "hate", "v1le", "vile", "sc4mmer", "scammer")] == [1, 1, 1, 1, 3, 3]


def brute_quality(text, net):
    """The network on one text in plain Python: every chunk, every place of a filter, most, mean, two layers."""
    raw, size = (text or "").encode(), quality.BLOCK
    many = max(1, -(-len(raw) // size))
    raw += b" " * (many * size + 3 - len(raw))
    filters, top = net.filters.transpose(2, 0, 1).tolist(), []
    for b in range(many):
        at = range(b * size, (b + 1) * size)
        top.append([max(f[0][raw[i]] + f[1][raw[i + 1]] + f[2][raw[i + 2]] + f[3][raw[i + 3]] for i in at) for f in filters])
    chunks = [[max(0.0, max(x)) for x in zip(top[i], top[min(i + 1, many - 1)], strict=True)] for i in range(max(1, many - 1))]
    x = [max(c[f] for c in chunks) for f in range(len(filters))] + [sum(c[f] for c in chunks) / len(chunks) for f in range(len(filters))]
    hidden = [max(0.0, float(net.dense_bias[k]) + sum(x[i] * float(net.dense[i, k]) for i in range(len(x)))) for k in range(net.dense.shape[1])]
    z = float(net.out_bias) + sum(h * float(w) for h, w in zip(hidden, net.out.tolist(), strict=True))
    return 1 / (1 + math.exp(-z))


def test_quality_scores_against_plain_python():
    """Texts of nothing, of a block and a byte more or less, and a long one."""
    rng = random.Random(31)
    letters = "abc déß$ \n日"
    cut = lambda n: "".join(rng.choice("abc d$\n") for _ in range(n))
    texts = [None, "", "a", *(cut(n) for n in (2, 3, 4, quality.BLOCK - 1, quality.BLOCK, quality.BLOCK + 1, 255, 256, 257, 511, 512, 513, 3000)), "".join(rng.choice(letters) for _ in range(700)), cut(100_000)]
    net = quality.fit([(cut(200) + ("$$" if i % 2 else ""), i % 2) for i in range(40)], epochs=2)
    got = quality.Scorer(net).score(texts)
    for t, score in zip(texts, got, strict=True):
        assert score == pytest.approx(brute_quality(t, net), abs=1e-5)
