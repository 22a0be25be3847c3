"""Operators on small tables against brute force, with nulls, empty and long
texts, ties, repeated rows, empty tables and clashing column names."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from peerlens.llm import (decontaminate, html_extract, langid, lm, near_dup, packing, quality,
                          sharding, text, topk, url_filter)
from peerlens.llm.components import components
from peerlens.llm.queries import URL_RULES, id_crc, tokenizer_path

SPACES = str.maketrans({c: " " for c in "\t\n\x0b\x0c\r"})
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(t):
    return [w for w in (t or "").translate(LOWER).translate(SPACES).split(" ") if w]


def make_texts(n=160, seed=1):
    rng = np.random.default_rng(seed)
    vocab = ["".join(rng.choice(list("abdeiklmnorstu"), rng.integers(1, 9))) for _ in range(400)]
    out = []
    for k in range(n):
        words = list(rng.choice(vocab, rng.integers(1, 90), p=None))
        if k % 3 == 1 and out:                      # near copies
            words = plain_words(out[rng.integers(len(out))]) or words
            words = [w if rng.random() > 0.03 else "x" + w for w in words]
        out.append(" ".join(words))
    out[5], out[6], out[7] = None, "", " \t\n "
    out[8] = out[9] = out[10]
    out[11] = out[12].upper().replace(" ", "\n ") if out[12] else "A b"
    out[13] = "one two three"
    out[14] = " ".join(rng.choice(vocab, 60_000))
    return out


@pytest.fixture(scope="module")
def texts():
    return make_texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, "aa" if k % 2 else "bb", k, "s") for k, t in enumerate(texts)]
    # columns named like results and helpers of the operators
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score long, shard string")


def empty(docs):
    return docs.where("false")


# ---------------------------------------------------------------- kernels
def test_words_match_python():
    rows = ["", None, "A b\tC", "  x ", "é\x0bß q", "w" * (text.WINDOW + 5), "a\x1fb"]
    w = text.words(pa.array(rows))
    assert list(np.diff(w.offsets)) == [len(plain_words(t)) for t in rows]
    h = w.hashes
    again = text.words(pa.array(["b c a", "w" * (text.WINDOW + 5)]))
    assert again.hashes[0] == h[1] and again.hashes[2] == h[0] and again.hashes[3] in h
    assert len(set(h.tolist())) == len(h)


# ---------------------------------------------------------------- op1
def test_url_filter(spark):
    urls = ["http://a.example.net/en/1", "http://x.net/", "http://x.net", "HTTP://A.ORG/fr/x?y#z",
            "https://example.com/de/", "http://notexample.com/de/1", None, "", "nothing",
            "http://EXAMPLE.net/en", "ftp://net/en/#a?b", "http://a..net/x", "://org/fr/q"]
    df = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)],
                               "page_id long, url string, host string")

    def judge(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = rest[:cut].translate(LOWER), rest[cut:]
        path = tail[:min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
        fits = [(len(r), r, v) for v, r in URL_RULES for h, p in [r.split("/", 1)]
                if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        best = max(fits, default=(0, None, "allow"))
        return host, path, best[1], best[2]

    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.url_filter(df, URL_RULES).collect()}
    assert got == {k: judge(u) for k, u in enumerate(urls)}
    assert url_filter.url_filter(df.where("false"), URL_RULES).count() == 0


def test_trie_partial_segments_and_precedence():
    trie = url_filter.Trie(url_filter.parse_rules(
        [("block", "a.com/x"), ("allow", "a.com/x/y"), ("allow", "a.com/x"), ("block", "b.a.com")]))
    assert trie.match("a.com", "/xy") == ("a.com/x", "block")
    assert trie.match("a.com", "/x/yz") == ("a.com/x/y", "allow")
    assert trie.match("b.a.com", "/x/y") == ("b.a.com", "block")
    assert trie.match("a.com", "/") is None


# ---------------------------------------------------------------- op2
def test_lm_counts_and_normalisation(docs, texts):
    rows = {r["doc_id"]: r for r in lm.score(docs, train=id_crc(7) != 2).collect()}
    train = Counter()
    for k, t in enumerate(texts):
        if zlib.crc32(str(k).encode()) % 7 != 2:
            train.update([*plain_words(t), None])
    n, v = sum(train.values()), len(train)
    for k, t in enumerate(texts):
        toks = [*plain_words(t), None]
        base = sum(math.log10((train[w] + 1) / (n + v + 1)) for w in toks)
        r = rows[k]
        assert (r["n_tokens"], r["n_known"]) == (len(toks), sum(train[w] > 0 for w in toks))
        assert r["train_tokens"] == n and r["base_score"] == pytest.approx(base)
        assert r["score"] < 0
    none = lm.score(empty(docs)).collect()
    assert none == []


def test_automaton_is_a_distribution_and_lanes_do_not_matter():
    rng = np.random.default_rng(2)
    counts = np.array([50, 30, 20, 9, 1, 1])
    hashes = np.sort(rng.integers(1, 2**63, 6, dtype=np.uint64))
    uni = lm.Unigrams(hashes, counts, int(counts.sum()), 6, 0.5, np.arange(4))
    pairs = (np.array([0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 0]), np.array([12, 9, 7]))
    triples = (np.array([(0 * 4 + 1) * 4 + 2]), np.array([6]))
    auto = lm.Automaton(uni, pairs, triples)
    for state in (-1, 0, 1, 2, 3, 4 + 0, 4 + 1, 4 + 2):
        total = 0.0
        for word in range(6):
            sid = word if word < 4 else -1
            weight, _ = auto.step(np.array([state]), np.array([sid]))
            total += 10 ** (weight[0] + (auto.word_logp[word] if auto.at_empty[0] else 0))
        weight, _ = auto.step(np.array([state]), np.array([-1]))
        total += 10 ** weight[0] * uni.unknown
        assert total == pytest.approx(1)
    toks = hashes[rng.integers(0, 6, 1500)]
    offs = np.array([0, 1, 1, 900, 1500])
    place = lm.Lookup(hashes)(toks)
    got = auto.score(toks, offs, place)
    for d in range(4):
        state, total = np.array([-1]), 0.0
        for t in range(offs[d], offs[d + 1]):
            sid = place[t] if place[t] < 4 else -1
            weight, state = auto.step(state, np.array([sid]))
            total += weight[0] + (auto.word_logp[place[t]] if auto.at_empty[0] else 0)
        assert got[d] == pytest.approx(total)


@pytest.mark.parametrize("share", [1e-6, 1e-3, 1.0])
def test_lm_keeps_every_repeated_ngram(spark, texts, share, monkeypatch):
    """Against brute force, with words and n-grams broadcast, in part, or all joined."""
    monkeypatch.setattr(lm, "WORD_SHARE", share)
    monkeypatch.setattr(lm, "HOT_SHARE", share, raising=False)
    texts = [*texts, "one two three one two three four", "rarely seen together", "rarely seen together too"]
    rows = [(k, t, k % 7 != 2) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    got = {r["doc_id"]: r["score"] for r in lm.score(docs, train=F.col("train")).collect()}
    c = Counter()
    for _, t, train in rows:
        toks = [*plain_words(t), None]
        for n in (1, 2, 3) if train else ():
            c.update(tuple(toks[i:i + n]) for i in range(len(toks) - n + 1))
    ones = {g: n for g, n in c.items() if len(g) == 1}
    total = sum(ones.values())
    n1, n2 = (sum(n == k for n in ones.values()) for k in (1, 2))
    d = min(0.9, max(0.1, n1 / (n1 + 2 * n2))) if n1 else 0.1
    kept = defaultdict(list)
    for g, n in c.items():
        if len(g) > 1 and n >= 2:
            kept[g[:-1]].append(g)

    def p(g):
        if len(g) == 1:
            return (c[g] - d) / total if c[g] else d * len(ones) / total
        if len(g) > 1 and c[g] >= 2:
            return (c[g] - lm.DISCOUNT) / c[g[:-1]]
        if len(g) == 3 and c[g[:-1]] < 2:
            return p(g[1:])
        return fail(g[:-1]) * p(g[1:])

    memo = {}

    def fail(h):
        if h not in memo:
            memo[h] = (max(1 - sum(p(g) for g in kept[h]), 1e-12)
                       / max(1 - sum(p(g[1:]) for g in kept[h]), 1e-12))
        return memo[h]

    for k, t, _ in rows:
        toks = [*plain_words(t), None]
        want = sum(math.log10(p(tuple(toks[max(0, i - 2):i + 1]))) for i in range(len(toks)))
        assert got[k] == pytest.approx(want), k


# ---------------------------------------------------------------- op3
def test_sharding(spark, docs, texts):
    rows = sharding.shard(docs.union(docs.limit(3)).union(
        spark.createDataFrame([(None, None, None, None, None)], docs.schema)), 4).collect()
    assert len(rows) == len(texts) + 4
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
        if r["doc_id"] is not None:
            raw = (texts[r["doc_id"]] or "").encode()
            assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
    for part in by.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
    assert sharding.shard(empty(docs), 4).count() == 0


def test_slot_maps():
    size = np.random.default_rng(3).integers(0, 5000, sharding.SLOTS)
    owner = sharding.rebalance(sharding.first_map(8), size, 8)
    load = np.bincount(owner, weights=size, minlength=8)
    assert load.max() - load.min() <= max(1, sharding.TOLERANCE * size.sum())
    grown = sharding.grow(owner, size, 8)
    moved = grown != owner
    assert moved.any() and (grown[moved] == 8).all()
    assert np.bincount(grown, weights=size, minlength=9)[8] == pytest.approx(size.sum() / 9, rel=0.02)


# ---------------------------------------------------------------- op4
PAGE = ("<html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body>"
        "<nav><ul><li><a href=/a>Home</a></li></ul></nav><!-- x --><div class=\"ad\">Buy now</div>"
        "<article><h1>Title {0}</h1><p><b>First &amp; second {0}.<br><p>Third\n  line &#233;.</p>"
        "</article><footer>&copy; us</footer>{1}")


def test_html_extraction(spark):
    rows = [(k, f"http://u/{k}", PAGE.format(k, "</body></html>" if k % 2 else "")) for k in range(60)]
    rows += [(None, None, PAGE.format("n", "")), (61, "u", None), (62, "u", ""), (61, "u", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html_extract.extract(df.withColumn("text", F.lit("x"))).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["page_id"] in (61, 62):
            want = ""
        else:
            k = "n" if r["page_id"] is None else r["page_id"]
            want = f"Title {k}\n\nFirst & second {k}.\n\nThird line é."
        assert (r["text"], r["n_chars"]) == (want, len(want))
    assert html_extract.extract(df.where("false")).count() == 0


def test_html_open_hidden_elements():
    def text(html):
        return [b.text for b in html_extract.blocks(html)]

    body = "<article><p>One.</p><p>Two.</p></article>"
    assert text(f"<html><head><title>T</title><meta x><body>{body}") == ["One.", "Two."]
    assert text(f"<html><head><title>T</title>{body}</html>") == ["One.", "Two."]
    assert text("<head><title>T</title>Bare text<p>One.") == ["Bare text", "One."]
    assert text(f"<head><noscript><iframe>x</iframe></noscript></head><body>{body}") == ["One.", "Two."]
    for tag in ("svg", "select", "object", "template", "noscript", "title", "textarea", "iframe",
                "script", "style", "math"):
        assert text(f"<body><div><{tag}>hidden{body}<p>Three.</div></body>") == ["One.", "Two.", "Three."], tag
        if tag in ("svg", "math", "select", "object", "template", "noscript"):  # may hold elements
            assert text(f"<body><{tag}>hidden{body}<{tag}>x</{tag}><p>Three.") == [
                "One.", "Two.", "Three."], tag
        assert text(f"<body><{tag}>hidden</{tag}>{body}") == ["One.", "Two."], tag
    assert text("<body><svg><foreignObject><p>hidden</p></foreignObject></svg><p>One.") == ["One."]


def test_html_whole_path_is_seen(spark):
    many = " ".join(f"u{k}-{k % 7}" for k in range(20))
    deep = "".join(f'<div class="w{k} {many}">' for k in range(4))
    short, long = (html_extract.blocks(f"<{tag}>{deep}<p>x") for tag in ("article", "aside"))
    assert len(short[0].path) > 24
    assert not np.array_equal(html_extract.vectors(short), html_extract.vectors(long))
    rng = np.random.default_rng(4)
    vocab = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(200)]

    def p():
        return " ".join(rng.choice(vocab, 12)) + "."

    rows, want = [], {}
    for k in range(80):     # the same words and lengths, so that the ancestors alone tell
        seq = [(rng.random() < 0.5, p()) for _ in range(10)]
        html = "".join(f'<{t}>{deep}<p>{x}</p></div></div></div></div></{t}>'
                       for m, x in seq for t in ["article" if m else "aside"])
        rows.append((k, "u", f"<html><body>{html}"))
        want[k] = "\n\n".join(x for m, x in seq if m)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}
    assert got == want


def test_lstm_gradients():
    rng = np.random.default_rng(0)
    net = html_extract.BiLstm(3, 2)
    x, mask = rng.standard_normal((4, 2, 3)), np.array([[1, 1], [1, 1], [1, 0], [1, 0]], bool)
    y = rng.integers(0, 2, (4, 2)).astype(float)

    def loss():
        s = net.scores(x, mask)
        return (np.where(mask, np.logaddexp(0, s) - y * s, 0)).sum() / mask.sum()

    grads = net.gradients(x, mask, y)
    for p, g in zip([*net.w, net.v], grads):
        for at in [(0,) * p.ndim, tuple(n - 1 for n in p.shape)]:
            old = p[at]
            p[at] = old + 1e-5
            up = loss()
            p[at] = old - 1e-5
            down = loss()
            p[at] = old
            assert g[at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


# ---------------------------------------------------------------- op5
def test_decontamination(spark):
    rng = np.random.default_rng(6)
    vocab = ["".join(rng.choice(list("abcdefghiklmnoprstuv"), 6)) for _ in range(3000)]
    items = [" ".join(rng.choice(vocab, 30)) for _ in range(12)]
    clean = [" ".join(rng.choice(vocab, 200)) for _ in range(80)]
    dirty = []
    for k, item in enumerate(items):
        w = item.split(" ")
        changed = [x if i % 6 else "zzz" for i, x in enumerate(w)] if k % 2 else [x.upper() + "!" for x in w]
        dirty.append(" ".join([*rng.choice(vocab, 150), *changed, *rng.choice(vocab, 90)]))
    rows = [(k, t) for k, t in enumerate(clean + dirty + [None, "", "short"])] + [(None, items[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit(1))
    bench = spark.createDataFrame([*enumerate(items), (98, None), (99, " . ")],
                                  "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(80 + k, k) for k in range(12)} | {(None, 0)}
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == set(range(80)) | {92, 93, 94}
    assert decontaminate.contaminated(docs, bench.where("false")).count() == 0
    assert decontaminate.contaminated(docs.where("false"), bench).count() == 0


def test_decontamination_of_long_items(spark):
    """Items of many passages, one of several parts: copied, shortened, halved."""
    rng = np.random.default_rng(16)
    vocab = ["".join(rng.choice(list("abcdefghiklmnoprstuv"), 6)) for _ in range(6000)]
    items = [list(rng.choice(vocab, n)) for n in (1000, 1000, 400, 55, 6200)]
    kept = [1.0, 0.75, 0.55, 0.8, 1.0]
    dirty = []
    for w, share in zip(items, kept):
        body = [x for x in w[:-4] if rng.random() < share]
        dirty.append(" ".join([*rng.choice(vocab, 130), *body, *w[-4:], *rng.choice(vocab, 90)]))
    clean = [" ".join(rng.choice(vocab, 700)) for _ in range(30)]
    docs = spark.createDataFrame([*enumerate(dirty + clean)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)],
                                  "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect())
    assert got == [(k, k) for k in range(5)]
    assert {r["doc_id"] for r in decontaminate.clean(docs, bench).collect()} == set(range(5, 35))


def test_lcs():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = rng.integers(0, 5, rng.integers(1, 20)), rng.integers(0, 5, rng.integers(0, 20))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        assert decontaminate.lcs(a, b) == t[-1, -1]


# ---------------------------------------------------------------- op6
def brute_components(texts):
    sets = {}
    for k, t in enumerate(texts):
        w = plain_words(t)
        sets[k] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k
    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in sets}


def test_near_duplicates(spark, docs, texts):
    more = docs.union(docs.limit(2)).union(spark.createDataFrame([(None, texts[0], None, None, None)],
                                                                 docs.schema))
    rows = near_dup.near_duplicates(more).collect()
    assert len(rows) == len(texts) + 3
    want = brute_components(texts)
    for r in rows:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])
    kept = near_dup.one_per_group(more)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()) == sorted(
        k for k, (_, c) in want.items() if c == k)
    assert near_dup.near_duplicates(empty(docs)).count() == 0


def test_near_duplicates_of_a_family_at_the_threshold(spark):
    """Members that keep their distance from the centre but link among each other."""
    rng = np.random.default_rng(12)
    base = [f"w{k}" for k in range(60)]
    texts = []
    for _ in range(150):
        w = list(base)
        for at in rng.choice(60, rng.integers(0, 4), replace=False):
            w[at] = f"x{rng.integers(3)}"
        texts.append(" ".join(w[:rng.integers(50, 61)]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"])
           for r in near_dup.near_duplicates(df).collect()}
    assert got == brute_components(texts)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 99)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {**{k: 0 for k in range(41)}, 99: 99, 100: 99}
    assert components(edges.where("false")).count() == 0


# ---------------------------------------------------------------- op7
def test_quality(spark):
    rng = np.random.default_rng(5)
    good = [" ".join(rng.choice(["the", "of", "and", "tree", "river"], 40)) for _ in range(60)]
    bad = [" ".join(rng.choice(["the***", "of###", "and%%%"], 40)) for _ in range(60)]
    rows = [(k, t) for k, t in enumerate(good + bad)] + [(200, None), (201, ""), (None, "the of")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(k, int(k < 60)) for k in range(120)] + [(3, None), (None, 1)],
                                   "doc_id long, quality int")
    model = quality.train(docs, labels, id_crc(4) != 2)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    assert all((got[k] >= 0.7) == (k < 60) for k in range(120))
    assert {r["doc_id"] for r in quality.keep(docs, model).collect()} >= set(range(60))
    nothing = quality.train(docs, labels.where("false"), F.lit(True))
    assert {r["score"] for r in quality.score(docs, nothing).collect()} == {0.5}


# ---------------------------------------------------------------- op8
def test_packing_round_trip(spark, docs, texts):
    from tokenizers import Tokenizer
    path = tokenizer_path()
    whole = Tokenizer.from_file(path)
    odd = ["İstanbul don't  x", "a<|endoftext|>b <|x", "ﬁ ½ é", "漢字 und ß", "a\x1fb\x85c"]
    extra = spark.createDataFrame([(1000 + k, t, None, None, None) for k, t in enumerate(odd)],
                                  docs.schema)
    got = defaultdict(list)
    rows = packing.pack(docs.union(extra), path).collect()
    for r in rows:
        got[r["doc_id"]].append(r)
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    for k, t in [*enumerate(texts), *((1000 + k, t) for k, t in enumerate(odd))]:
        want = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        parts = sorted(got[k], key=lambda r: r["start"])
        assert [i for r in parts for i in r["ids"]] == want
        for r in parts:
            assert r["length"] == len(r["ids"]) <= 2048 and r["length"] & (r["length"] - 1) == 0
            assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
            assert r["doc_tokens"] == len(want) and r["offset"] == 0
    assert packing.pack(empty(docs), path).count() == 0
    assert packing.pieces(5000) == [2048, 2048, 512, 256, 128, 8]


# ---------------------------------------------------------------- op9
def test_language_id(spark):
    rng = np.random.default_rng(7)
    syllables = {"aa": ["ka", "to", "mi", "ru"], "bb": ["sch", "ung", "keit", "ver"]}

    def line(lang):
        return " ".join("".join(rng.choice(syllables[lang], rng.integers(1, 4))) for _ in range(30))

    rows = [(k, line("aa" if k % 2 else "bb"), "aa" if k % 2 else "bb") for k in range(200)]
    rows += [(300, None, "aa"), (301, "12 !!", "aa"), (302, "", None), (None, line("aa"), "aa"),
             (303, "Ж" * 300, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn(
        "score", F.lit(1))
    models = langid.train(docs, id_crc(4) != 2)
    got = {r["doc_id"]: r for r in langid.predict(docs, models).collect()}
    assert all(got[k]["lang_pred"] == lang for k, _, lang in rows[:200])
    assert [got[k]["lang_pred"] for k in (300, 301, 302)] == ["und"] * 3
    assert got[303]["rejected"] and not any(got[k]["rejected"] for k in range(200))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["doc_id"] for r in langid.keep(docs, models).collect()} == {None, *range(200)}
    untrained = langid.train(empty(docs))
    assert {r["lang_pred"] for r in langid.predict(docs, untrained).collect()} == {"und"}


def test_language_id_learns_every_language(spark):
    """More languages than one block or any cap, and one of over-long texts only."""
    rng = np.random.default_rng(8)
    letters = list("abcdefghijklmnopqrstuvwxyz")
    names = [f"l{k:02d}" for k in range(70)]
    syllables = {n: ["".join(rng.choice(letters, 3)) for _ in range(4)] for n in names}

    def line(lang, n=40):
        return " ".join("".join(rng.choice(syllables[lang], rng.integers(1, 4))) for _ in range(n))

    rows = [(4 * i + k, line(n, 4500 if n == "l69" else 40), n)
            for i, n in enumerate(names) for k in range(4)]
    assert all(len(t) > 20_000 for _, t, n in rows if n == "l69")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, langid.train(docs)).collect()}
    assert all(got[k] == lang for k, _, lang in rows)
    assert langid.keep(docs, langid.train(docs)).count() == len(rows)


def test_kneser_ney_sums_to_one():
    models = langid.fit({"a": ["banana bandana cabana"] * 3, "b": ["xyz zyx"] * 3})
    c = langid.symbols(langid.code_points("ban"))
    letters = sorted(set("banancdxyz"))
    total = 0.0
    for last in [*letters, " "]:
        probe = langid.symbols(langid.code_points("ba" + last))
        at, grams = langid.events(probe)
        bits = models.bits(grams, langid.contexts(probe, at))
        total += 2.0 ** -bits[2, 0]
    unseen = (langid.UNKNOWN_SYMBOLS - len(letters) - 1) / langid.UNKNOWN_SYMBOLS
    assert len(c) == 3 and 0.9 < total <= 1.0 + 1e-6 and total + unseen >= 1.0 - 1e-6


# ---------------------------------------------------------------- op10
def test_topk(spark):
    rng = np.random.default_rng(9)
    vectors = rng.standard_normal((600, 6)).round(2)
    vectors[100:300] = vectors[100]                       # a hot vector, and ties
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(vectors)]
    rows += [(700, None), (701, [1.0, None]), (702, [float("nan")]), (None, [1.0]), (800, []),
             (900, [2.0]), (5, rows[5][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn(
        "rank", F.lit("x"))
    got = [tuple(r) for r in topk.topk(df, F.col("id") % 100 == 0, 10).collect()]
    data = {k: v for k, v in rows if k is not None and v is not None
            and all(x is not None and math.isfinite(x) for x in v)}
    ints = {k: [math.floor(1024 * x) for x in v] for k, v in data.items()}
    want = []
    for q in (k for k in ints if k % 100 == 0):
        scored = sorted((-sum(a * b for a, b in zip(ints[q], v)), k) for k, v in ints.items() if k != q)
        want += [(q, n + 1, k, -s) for n, (s, k) in enumerate(scored[:10])]
    assert sorted(got) == sorted(want)
    few = topk.topk(df.where("vec_id IN (100, 900, 800)"), F.col("id") % 100 == 0, 10).collect()
    assert len(few) == 6
    assert topk.topk(df.where("false"), F.col("id") % 100 == 0).count() == 0


def test_products_beyond_doubles():
    a = np.array([[2**39 + 1, 3]])
    assert topk.products(a, np.array([[2**20 + 1, 5]]))[0, 0] == (2**39 + 1) * (2**20 + 1) + 15
