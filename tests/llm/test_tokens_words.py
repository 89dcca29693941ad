"""Token counts by resynchronisation, alignment of tokenizers and spelling variants, against brute force."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenlake.llm import alignment, resync, spelling
from lumenlake.llm.queries import OTHER_VOCABULARY, VOCABULARY, vocabulary_path
from tests.llm.test_spark import empty, frame, odd, rows  # noqa: F401


def loaded(name, plain=False):
    with open(vocabulary_path(name), "rb") as f:
        return resync.coder(f.read(), name.endswith(".json"), plain)


def whole(tokenizer, text):
    """The ids of a text by the library alone."""
    return tokenizer.library.encode(text, add_special_tokens=False).ids if tokenizer.prefix == 0 else tokenizer.library.encode(text)


# --- op11 -------------------------------------------------------------------------------------------------------

HARD = ["a" * 5000, " " * 5000, "\n \n" * 900, "日本" * 900, "it's <|endoftext|> we'll " * 90, "<|endoftext|>" * 300, "'" * 2000, "'ll" * 800, "é" * 2000, "ab" * 2000, " a" * 2000, "123456" * 500, "　 " * 900, "<|endof" * 300]


@pytest.mark.parametrize("name", [VOCABULARY, OTHER_VOCABULARY])
@pytest.mark.parametrize("chunk, overlap", [(1000, 40), (300, 8), (64, 4)])
def test_spliced_ids_are_those_of_the_whole(name, chunk, overlap):
    tokenizer = loaded(name)
    r = resync.Resync(tokenizer, chunk, overlap)
    for text, ids in zip(HARD, r.ids(HARD), strict=True):
        assert ids.tolist() == whole(tokenizer, text), text[:20]
    assert r.splices and (r.widened or overlap == 40)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([*"ab '\n<|>ls日😀1.", "\u0301", "<|endoftext|>"]), min_size=200, max_size=900).map("".join), st.sampled_from([(100, 12), (50, 4)]))
def test_any_text_is_spliced_right(text, sizes):
    for name in (VOCABULARY, OTHER_VOCABULARY):
        tokenizer = loaded(name)
        assert next(resync.Resync(tokenizer, *sizes).ids([text])).tolist() == whole(tokenizer, text)


def test_plain_prose_is_spliced_without_widening():
    rng = random.Random(3)
    text = " ".join(rng.choice(["the", "reason", "for", "this,", "Straße", "numbers", "12"]) for _ in range(20000))
    r = resync.Resync(loaded(VOCABULARY))
    assert next(r.ids([text])).tolist() == whole(loaded(VOCABULARY), text)
    assert r.splices == len(text.encode()) // resync.CHUNK and not r.widened and not r.whole


def test_a_text_that_tokens_do_not_spell_is_encoded_whole():
    r = resync.Resync(loaded(OTHER_VOCABULARY), 100, 10)
    text = "x▁" * 300
    assert next(r.ids([text])).tolist() == whole(loaded(OTHER_VOCABULARY), text) and r.whole == 1


@pytest.mark.parametrize("name", [VOCABULARY, OTHER_VOCABULARY])
def test_counts(spark, odd, empty, name):  # noqa: F811
    tokenizer, path = loaded(name), vocabulary_path(name)
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["hello", "world", "日本語", "it's", "<|endoftext|>"]) for _ in range(6000)), " " * 40000, "ab" * 20000, "short", None]
    docs = frame(spark, [*texts, texts[0]])
    got = resync.count_tokens(docs, path, spread=5000, piece_overlap=64, chunk=1000, overlap=32)
    assert got.columns == [*docs.columns, "n_bytes", "n_tokens", "over_limit"]
    for r in got.collect():
        n = len(whole(tokenizer, r.text or ""))
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((r.text or "").encode()), n > 512)
    assert got.count() == 6
    assert rows(resync.count_tokens(odd, path), "doc_id", "n_tokens") == sorted(((r.doc_id, len(whole(tokenizer, r.text or ""))) for r in odd.collect()), key=str)
    assert resync.count_tokens(empty, path).count() == 0
    clash = odd.withColumn("N_TOKENS", odd.doc_id)
    assert resync.count_tokens(clash, path).columns == [*odd.columns, "n_bytes", "n_tokens", "over_limit"]


# --- op12 -------------------------------------------------------------------------------------------------------

def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(docs):
    """By comparing all words with all."""
    n = collections.Counter()
    for doc, text in docs:
        run = ""
        for c in [*(text or ""), " "]:
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
            elif run:
                h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
                n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
                run = ""
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    out, form = {}, {}
    for w in n:
        others = [v for v in n if near(w, v)]
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
        out[w] = (n[w], len(others))
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (w, form[w], root, *out[w], None if form[w] is None else n[form[w]])
    return sorted(out.values(), key=str)


def test_variants(spark, odd, empty):  # noqa: F811
    rng = random.Random(5)
    texts = []
    for base in ("lettering", "ÀÉÑñóüß×÷", "abababab", "aaaaaaaaa", "Reasonable"):
        for k, times in enumerate((1500, 130, 12, 2)):
            word = base
            for _ in range(k):
                i, c = rng.randrange(len(word)), rng.choice("abñ÷é")
                word = rng.choice((word[:i] + word[i + 1 :], word[:i] + c + word[i + 1 :], word[:i] + c + word[i:]))
            texts += [(word + rng.choice((" ", ", ", "9"))) * times]
    texts += [" ".join("".join(rng.choice("ab") for _ in range(rng.choice((7, 8, 9)))) for _ in range(400)) for _ in range(3)]
    texts += ["q" * 3000 + " " + "q" * 3000 + " " + "q" * 2999 + "r " + "q" * 2999 + "r", None, "", "same same"]
    ids = [*range(len(texts) - 1), None]
    got = rows(spelling.group_variants(frame(spark, texts, ids)), "word", "form", "root", "n", "n_near", "form_n")
    assert got == variants(zip(ids, texts, strict=True))
    assert any(r[2] not in (r[0], r[1]) for r in got)  # forms of forms
    assert rows(spelling.group_variants(odd), "word", "n") == [("x" * 3000, 1)][:0]
    assert spelling.group_variants(empty).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("abc"), min_size=7, max_size=12), st.integers(0, 12), st.sampled_from("abcd"), st.integers(0, 2))
def test_near_words_share_a_rare_bigram_in_place(word, i, c, kind):
    """The filter's claim, in plain Python: the first bigram left alone is among the three rarest of both."""
    i = min(i, len(word) - 1)
    other = (word[:i] + c + word[i:], word[:i] + c + word[i + 1 :], word[:i] + word[i + 1 :])[kind]
    if other == word:
        return
    rank = {a + b: (zlib.crc32((a + b).encode()) % 3, a + b) for a in "abcd" for b in "abcd"}
    a, b = (sorted((rank[w[k : k + 2]], k) for k in range(len(w) - 1))[:3] for w in sorted((word, other), key=len))
    shift = abs(len(other) - len(word))
    assert any(g == h and 0 <= q - p <= shift for g, p in a for h, q in b)


# --- op13 -------------------------------------------------------------------------------------------------------

def aligned(a, b, text):
    """Counts, groups and links of a text, token by token."""
    ids = (whole(a, " " + text), whole(b, text))
    if not text or any(b"".join(t.bytes[i] for i in x) != (" " + text).encode() for t, x in zip((a, b), ids, strict=True)):
        return 0, 0, 0, "", collections.Counter()
    spans = []
    for t, x in zip((a, b), ids, strict=True):
        end = np.cumsum([len(t.bytes[i]) for i in x]).tolist()
        spans.append(list(zip([0, *end[:-1]], end, x, strict=True)))
    both = sorted({s[1] for s in spans[0]} & {s[1] for s in spans[1]})
    groups = ["|".join(",".join(str(s[2]) for s in side if low < s[1] <= high) for side in spans) for low, high in zip([0, *both[:-1]], both, strict=True)]
    links = collections.Counter((p[2], q[2]) for p in spans[0] for q in spans[1] if p[0] < q[1] and q[0] < p[1])
    return len(ids[0]), len(ids[1]), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest(), links


def brute_alignment(a, b, docs):
    each = [(i, *aligned(a, b, t or "")) for i, t in docs]
    count = collections.Counter(pair for *_, links in each for pair in links)
    most = collections.defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    return sorted(((i, na, nb, ng, sum(links.values()), sum(m for p, m in links.items() if count[p] == most[p[0]]), sum(m * count[p] for p, m in links.items()), sha)
                   for i, na, nb, ng, sha, links in each), key=str)


@pytest.mark.parametrize("at_once, block", [(alignment.AT_ONCE, alignment.BLOCK), (60, 400)])
def test_alignment(spark, odd, empty, at_once, block):  # noqa: F811
    a, b = loaded(VOCABULARY, True), loaded(OTHER_VOCABULARY, True)
    rng = random.Random(6)
    texts = ["a▁b", "x<s>y<|endoftext|>", "日本語 é", "a" * 300, "\n\n  ", "\x00", *(" ".join(rng.choice(["reason", "Straße", "naïve", "it's", "tokenizers", "12"]) for _ in range(rng.randint(1, 60))) for _ in range(25))]
    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    paths = vocabulary_path(VOCABULARY), vocabulary_path(OTHER_VOCABULARY)
    for docs in (frame(spark, texts), odd):
        got = alignment.align(docs.repartition(3), *paths, at_once=at_once, block=block)
        assert tuple(sorted(got.columns)) == tuple(sorted(columns))
        assert rows(got, *columns) == brute_alignment(a, b, [(r.doc_id, r.text) for r in docs.collect()])
    assert alignment.align(empty, *paths).count() == 0


def test_links_are_packed_without_loss():
    sizes, numbers, many = np.array([2, 0, 3]), np.array([5, 900000, 0, 1, 70000]), np.array([1, 2, 1, 300, 1])
    for x, y in zip((sizes, numbers, many), alignment._unpack(alignment._pack(sizes, numbers, many)), strict=True):
        assert x.tolist() == y.tolist()
