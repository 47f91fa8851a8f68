"""Operators against brute force on small tables with nulls, empty, long, equal and repeated rows, and clashing columns."""

import hashlib
import os
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from ordkv.llm import bpe, chat, embeddings, mixing, quality, sharding, similar, simhash, suffix, urls, warc
from ordkv.llm.common import Scratch, connected_components, repeated_rows
from ordkv.llm.queries import URL_RULES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean"


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [sentence(rng, rng.randint(1, 120)) for _ in range(25)]
    near = [t.replace(t.split()[0], "Other", 1) for t in base[:8]]
    shared = sentence(rng, 60)
    odd = [None, "", " \t\n", "one", "two words", "Ünï çödé ✓ \U0001f600 text", "a b a b " * 60, "x" * 900, "x" * 450, "A\nB\nA\n\nA", "## $$ ** && <x> | y", sentence(rng, 4000)]
    return base + near + [f"{sentence(rng, 9)} {shared} {sentence(rng, 9)}" for _ in range(4)] + odd + base[:3]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 5}", 0, -1, True) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[0], None, None, None, None, None), (None, None, None, "é", 0, 0, False)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)


def slow_print(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    s = [" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, 1))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(nodes, linked):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash(docs, empty):
    found = simhash.near_duplicates(docs).collect()
    rows = [(r.doc_id, r.text, slow_print(r.text)) for r in docs.collect()]
    assert Counter((r.doc_id, r.fp & (2**64 - 1)) for r in found) == Counter((d, f) for d, _, f in rows)
    prints = {f for *_, f in rows}
    comp = components(prints, [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 2])
    least = defaultdict(list)
    for d, _, f in rows:
        least[comp[f]].append(d)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    assert all(r.component_id == least[comp[r.fp & (2**64 - 1)]] for r in found)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(least)
    assert not simhash.near_duplicates(empty).collect() and not simhash.keep_one(empty).collect()


@pytest.mark.parametrize("limit", [0, 1, 3, 16])
def test_simhash_links_for_any_bucket_limit(spark, limit):
    rng = random.Random(limit)
    seeds = [rng.getrandbits(64) for _ in range(3)]
    prints = {s ^ sum(1 << rng.choice([1, 5, 9, 33, 40, 63]) for _ in range(rng.randint(0, 3))) & (2**64 - 1) for s in seeds for _ in range(60)}
    prints |= {s ^ (1 << b) for s in seeds for b in range(0, 64, 7)}
    signed = np.array(sorted(prints), np.uint64).view(np.int64).tolist()
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    scratch = Scratch(spark)
    found = {r.node: r.component for r in connected_components(scratch, simhash.links(scratch, frame, limit)).collect()}
    want = components(signed, [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2])
    assert {x: found.get(x, x) for x in signed} == want


@pytest.mark.parametrize("most", [0, 100])
def test_urls(spark, monkeypatch, most):
    monkeypatch.setattr(urls, "BROADCAST_RULES", most)
    cases = ["http://example.com/en/1", "https://www.Example.COM/en/1?q", "https://a.www.example.com/en/", "http://x.net/es/y", "http://x.net/es", "http://net/fr/#f", "http://com", "http://com/", "nothing", None, "", "a://b://c.com/x", "ftp://h?x=/en/", "http://notexample.com/en/", "http://a.com\n/en/x"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate([*cases, *cases])], "page_id long, url string, host string")

    def slow(u):
        _, _, rest = (u or "").partition("://") if "://" in (u or "") else ("", "", "")
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.host + r.path), default=None)
        return host, path, best and best.host + best.path, best.verdict if best else "allow"

    found = urls.judge(pages, URL_RULES).collect()
    assert len(found) == len(cases) * 2
    assert all((r["__host"], r["__path"], r["__rule"], r["__verdict"]) == slow(r.url) for r in found)
    clash = urls.judge(pages.withColumns({c: F.lit("old") for c in ("__rule", "__mix", "c0", "token")}), URL_RULES)
    assert clash.columns[3:] == ["__mix", "c0", "token", "__host", "__path", "__rule", "__verdict"] and Counter(r["__rule"] for r in clash.collect()) == Counter(r["__rule"] for r in found)
    every = urls.judge(pages, [urls.Rule("block", "", "/e"), *URL_RULES]).where("url = 'http://notexample.com/en/'").first()
    assert every["__rule"] == "com/"
    any_path = urls.judge(spark.createDataFrame([("http://a.net.network/x",), ("http://b.A.net",), ("http://a.net?q",), ("http://a.network",)], "url string"), [urls.Rule("block", "A.net", "")])
    assert [r["__verdict"] for r in sorted(any_path.collect(), key=lambda r: r.url)] == ["allow", "block", "allow", "block"]
    for bad in (("deny", "a"), ("block", "a/b"), ("block", "a", "x")):
        with pytest.raises(ValueError):
            urls.Rule(*bad)
    assert not urls.judge(pages.limit(0), URL_RULES).collect()


def test_only_rules_of_the_rarest_token_are_run(spark):
    rules = [urls.Rule("block", "spam.example.com", "/x/"), urls.Rule("block", "example.com", "/x/"), urls.Rule("allow", "", "/y"), urls.Rule("block", "com", "/")]
    assert [t for t, *_ in urls.index(rules, {"h:com": 9, "h:example": 5, "h:spam": 1, "p:x": 2})] == ["h:spam", "p:x", "*", "h:com"]
    cases = [f"http://a{i}.example.com/z/" for i in range(5)] + ["http://spam.example.com/q", "http://b.org/x/y"]
    host, path = urls.parse(F.col("url"))
    spread = spark.createDataFrame([(u,) for u in cases], "url string").withColumn("token", F.explode(urls.tokens(host, path)))
    run = Counter((r.url, r.rule) for r in urls.candidates(spread, rules, lambda x: x).collect())
    assert run == Counter([(u, "/y") for u in cases] + [(u, "com/") for u in cases[:6]] + [("http://spam.example.com/q", "spam.example.com/x/"), ("http://b.org/x/y", "example.com/x/")])


def slow_base(t):
    w, c, at = re.findall(r"[^\x20\x09-\x0D]+", t or ""), Counter(), set()
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    c.update(grams)
    for i, g in enumerate(grams):
        at |= set(range(i, i + 5)) if c[g] > 1 else set()
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(at)


def slow_votes(t):
    """The rules' votes, from the text."""
    t = t or ""
    n, chars, symbols, again_lines, again = slow_base(t)
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = sum(1 for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x))
    letters, upper = sum(c.isalpha() for c in t), sum(unicodedata.category(c) == "Lu" for c in t)
    stops = sum(t.count(c + g) for c in ".?!;:" for g in " \t\n\x0b\x0c\r") + (t[-1:] in list(".?!;:"))
    per, share, length, kinds = max(n, 1), upper / max(letters, 1), chars / max(n, 1), len(set(w))
    bad = lambda x: -1 if x else 0
    both = lambda x, y: -1 if x else 1 if y else 0
    return (
        bad(symbols / per >= 0.15), bad(share >= 0.6 and letters >= 20), bad(t.count("!") / per >= 0.3), bad(again_lines > 0 and again_lines >= 0.3 * lines),
        bad(again / per >= 0.15), bad(length < 2 or length > 18), both(letters < 0.6 * chars, letters >= 0.75 * chars),
        both(kinds / per < 0.15 and n >= 50, kinds / per >= 0.35 and n >= 10), both(stops == 0 and n >= 60, 0.02 <= stops / per <= 0.35 and symbols / per < 0.05 and share < 0.4),
    )


def slow_model(rows, rounds):
    """(prior, rates of good, rates of junk) by expectation-maximisation over rows, with the documented priors and order."""
    k, start, m = len(rows[0]), (0.7, [0.02, 0.58, 0.40], [0.30, 0.55, 0.15]), max(1.0, 0.02 * len(rows))
    hot = np.array([[[v == x for x in (-1, 0, 1)] for v in r] for r in rows], float)
    prior, rate = start[0], [np.tile(start[1], (k, 1)), np.tile(start[2], (k, 1))]
    for _ in range(rounds):
        like = [np.prod((hot * r).sum(2), axis=1) for r in rate]
        p = prior * like[0] / (prior * like[0] + (1 - prior) * like[1])
        prior = (p.sum() + m * start[0]) / (len(rows) + m)
        good = np.einsum("i,ijk->jk", p, hot) + m * start[0] * np.array(start[1])
        junk = np.einsum("i,ijk->jk", 1 - p, hot) + m * (1 - start[0]) * np.array(start[2])
        for j in range(k):
            g, b = good[j, 0] / good[j].sum(), junk[j, 0] / junk[j].sum()
            if b < g:
                g = b = (good[j, 0] + junk[j, 0]) / (good[j].sum() + junk[j].sum())
            y, z = good[j, 2] / good[j, 1:].sum(), junk[j, 2] / junk[j, 1:].sum()
            if y < z:
                y = z = (good[j, 2] + junk[j, 2]) / (good[j, 1:].sum() + junk[j, 1:].sum())
            rate[0][j], rate[1][j] = [g, (1 - g) * (1 - y), (1 - g) * y], [b, (1 - b) * (1 - z), (1 - b) * z]
    return prior, rate


def slow_posteriors(texts, rounds=1000):
    votes = [slow_votes(t) for t in texts]
    prior, (good, junk) = slow_model(votes, rounds)
    odds = lambda v: np.log(prior / (1 - prior)) + sum(np.log(good[j][x + 1] / junk[j][x + 1]) for j, x in enumerate(v))
    return [1 / (1 + np.exp(-odds(v))) for v in votes]


def slow_failed(t):
    n, *_, again = slow_base(t)
    return n < 10 or 100 * again > 20 * n


def test_quality(docs, empty):
    found = quality.judge(docs, prefix="q_").collect()
    posterior = dict(zip([r.text for r in found], slow_posteriors([r.text for r in found])))
    for r in found:
        assert tuple(r[f"q_{k}"] for k in quality.BASE) == slow_base(r.text)
        assert r.q_base_failed == slow_failed(r.text)
        assert abs(r.q_posterior - posterior[r.text]) < 1e-4
        if abs(posterior[r.text] - 0.5) > 1e-4:
            assert r.q_kept == (not slow_failed(r.text) and posterior[r.text] >= 0.5)
    assert len(found) == docs.count() and quality.keep_good(docs).columns == docs.columns
    assert not quality.judge(empty, prefix="q_").collect()


@pytest.mark.parametrize("prior", [0.1, 0.3, 0.6, 0.95])
def test_label_model_recovers_what_was_planted(prior):
    rng = random.Random(int(100 * prior))
    good = [[0.02 + 0.01 * j, 0.5, 0.48 - 0.01 * j] for j in range(7)]
    junk = [[0.45 - 0.02 * j, 0.45, 0.1 + 0.02 * j] for j in range(7)]
    rows = [tuple(rng.choices((-1, 0, 1), r)[0] for r in (good if rng.random() < prior else junk)) for _ in range(6000)]
    counted = dict(Counter(rows))
    model = quality.LabelModel(7)
    last = model.score(counted)
    for _ in range(200):
        change = model.step(counted)
        assert model.score(counted) >= last - 1e-9 * abs(last)
        last = model.score(counted)
        assert all(abs(sum(r) - 1) < 1e-12 and min(r) > 0 for r in (*model.good, *model.junk))
        if change < 1e-6:
            break
    assert abs(model.prior - prior) < 0.06
    assert np.abs(np.array(model.good) - good).max() < 0.08 and np.abs(np.array(model.junk) - junk).max() < 0.1
    slow_prior, slow_rate = slow_model(rows, 50)
    fast = quality.LabelModel(7).fit(counted, rounds=50)
    assert np.allclose(fast.good, slow_rate[0], atol=1e-6) and np.allclose(fast.junk, slow_rate[1], atol=1e-6) and abs(fast.prior - slow_prior) < 1e-6


CLASHES = ["__w", "__l", "__h", "__id", "__hash", "__kept", "__doc", "__mark", "__mix", "__u", "__copy", "__source", "__host", "c0", "c1", "mark", "doc", "cut", "t", "u", "copies", "salt", "label", "before", "level", "k", "a.b"]


def test_columns_with_clashing_names(spark, docs):
    """Operators that give their rows back keep every column, whatever its name."""
    docs = docs.where("doc_id < 9 OR doc_id IS NULL").coalesce(1)
    wide = docs.withColumns({n: F.lit(f"x{i}") for i, n in enumerate(CLASHES)})
    for f in (quality.keep_good, simhash.keep_one, similar.keep_one, suffix.without_repeats, lambda d: mixing.repeat_by_mix(d, [1, 2, 3])):
        found, plain = f(wide), f(docs)
        assert found.columns == wide.columns
        rows = found.collect()
        assert all(r[n] == f"x{i}" for r in rows for i, n in enumerate(CLASHES))
        assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in plain.collect())
    for f in (suffix.removal_report, lambda d: sharding.shards(d, 8)):
        assert Counter(map(tuple, f(wide).collect())) == Counter(map(tuple, f(docs).collect()))


def test_texts_of_millions_of_bytes(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    passage = " ".join(word() for _ in range(120))
    long = " ".join(word() for _ in range(210_000))[: (1 << 20) - 300] + passage + " ".join(word() for _ in range(20_000))
    frame = spark.createDataFrame([(0, long), (1, f"here {passage} there"), (2, "x" * 3_000_000)], "doc_id long, text string")
    data = [r.text.encode() for r in frame.collect()]
    places = defaultdict(set)
    for i, d in enumerate(data[:2]):
        for j in range(len(d) - 199):
            places[hash(d[j : j + 200])].add((i, j))
    hit = {p for v in places.values() if len(v) > 1 for p in v}
    for r in suffix.removal_report(frame).collect():
        if r.doc_id == 2:
            assert (r.n_removed, r.n_spans, r.kept_sha256) == (3_000_000, 1, hashlib.sha256(b"").hexdigest())
            continue
        d, cut = data[r.doc_id], bytearray(len(data[r.doc_id]))
        for i, j in hit:
            if i == r.doc_id:
                cut[j : j + 200] = b"\1" * 200
        assert r.kept_sha256 == hashlib.sha256(bytes(x for x, c in zip(d, cut) if not c)).hexdigest()
    prints = {r.doc_id: r.fp & (2**64 - 1) for r in simhash.near_duplicates(frame).collect()}
    assert prints[0] == slow_print(long)
    row = quality.judge(frame, prefix="q_").where("doc_id = 0").first()
    assert row.q_n_words == len(long.split()) and row.q_n_repeat_words == slow_base(long)[-1]


def test_quality_keeps_clean_and_rejects_junk(spark):
    rng = random.Random(9)
    clean = [" ".join(sentence(rng, 12) for _ in range(6)) for _ in range(150)]
    junk = [" ".join(w + rng.choice(["***", "###", "$$$"]) for w in sentence(rng, 60).split()) for _ in range(15)] + [sentence(rng, 60).upper().replace(" ", "!! ") for _ in range(15)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(clean + junk)], "doc_id long, text string")
    assert {r.doc_id for r in quality.keep_good(docs).collect()} == set(range(150))


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((40, 64))
    v = np.concatenate([c + 0.04 * np.linalg.norm(c) * rng.standard_normal((6, 64)) for c in centres] + [rng.standard_normal((60, 64))]).astype(np.float32)
    rows = [(i, x.tolist(), None) for i, x in enumerate(v)]
    rows += [(500 + i, v[0].tolist(), 1) for i in range(50)] + [(600, None, 1), (601, [0.0] * 64, 1), (602, [1.0, None], 1), (603, [float("nan")] * 64, 1), (604, [1.0, 2.0], 1), (605, [], 1), (None, v[7].tolist(), 1)]
    found = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, n_links int")).collect()}
    assert len(found) == len(rows)
    good = [(-(2**63) if i is None else i, np.array(x, float)) for i, x, _ in rows if x and len(x) == 64 and None not in x and np.isfinite(x).all() and any(x)]
    unit = np.stack([x / np.linalg.norm(x) for _, x in good])
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    want, got = near.sum(1), np.array([found[None if i == -(2**63) else i].n_links for i, _ in good])
    assert (got <= want).all() and got.sum() >= 0.9 * want.sum()
    for i in (600, 601, 602, 603, 604, 605):
        assert (found[i].n_links, found[i].component_id, found[i].kept) == (0, i, True)
    assert found[500].component_id == found[0].component_id
    assert not embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect()


def _hard_vectors():
    rng = np.random.default_rng(3)
    noise = lambda n, d=64: rng.standard_normal((n, d)) / np.sqrt(d)
    mean = noise(1)[0] / np.linalg.norm(noise(1)[0])
    yield "common mean, dense", 4 * mean + noise(500)
    yield "common mean, clusters", np.concatenate([3 * mean + x + 0.2 * noise(20) for x in noise(40)])
    yield "low rank", rng.standard_normal((900, 4)) @ rng.standard_normal((4, 128))
    one = noise(400)
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    side = noise(400)
    side -= (side * one).sum(1, keepdims=True) * one
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    yield "at the threshold", np.concatenate([one, 0.9505 * one + np.sqrt(1 - 0.9505**2) * side])
    yield "two groups of near copies", np.concatenate([noise(1) + 0.1 * noise(300), noise(1) + 0.02 * noise(200), noise(300)])


@pytest.mark.parametrize(("name", "v"), list(_hard_vectors()), ids=lambda x: x if isinstance(x, str) else "")
def test_embeddings_recall(spark, name, v):
    x = v.astype(np.float32).astype(float)
    found = {r.vec_id: r for r in embeddings.near_duplicates(spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<float>").repartition(3)).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    want, got = near.sum(1), np.array([found[i].n_links for i in range(len(x))])
    assert want.sum() > 300 and (got <= want).all() and got.sum() >= 0.9 * want.sum()
    true = components(range(len(x)), np.argwhere(near).tolist())
    assert all(true[found[i].component_id] == true[i] for i in range(len(x)))


def test_embeddings_of_near_copies_are_not_compared_in_pairs(spark):
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.standard_normal(32) + 0.05 * rng.standard_normal((600, 32)), rng.standard_normal((400, 32))])
    classes = spark.createDataFrame([(i, x.tolist(), 1 + i % 2) for i, x in enumerate(v)], "cid long, v array<double>, n long")
    scratch = Scratch(spark)
    _, far = embeddings.links(scratch, classes)
    assert {r.cid: r.far for r in far.collect()}[0] == 899
    compared = [p for p in sorted(os.listdir(scratch.root.removeprefix("file://"))) if p.endswith("-candidates")]
    assert spark.read.parquet(f"{scratch.root}/{compared[0]}").count() < 600 * 599 / 2 / 5


def test_embeddings_of_any_length(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(64).tolist()) for i in range(20)]
    rows += [(100, [1.0, 2.0]), (101, [1.0, 2.0]), (102, [1.0, 2.1]), (103, [-1.0, 2.0]), (104, [3.0]), (105, [4.0]), (106, [-3.0])]
    rows += [(200, [1.0] * 10), (201, [1.0] * 9 + [1.1])]
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert [found[i] for i in (100, 101, 102, 103)] == [(2, 100, True), (2, 100, False), (2, 100, False), (0, 103, True)]
    assert [found[i] for i in (104, 105, 106, 200, 201)] == [(1, 104, True), (1, 104, False), (0, 106, True), (1, 200, True), (1, 200, False)]
    assert all(found[i] == (0, i, True) for i in range(20))


def slow_cut(data, count, width):
    covered = bytearray(len(data))
    for i in range(len(data) - width + 1):
        if count[data[i : i + width]] > 1:
            covered[i : i + width] = b"\1" * width
    return bytes(x for x, c in zip(data, covered) if not c), len(re.findall(rb"\x01+", bytes(covered)))


@pytest.mark.parametrize("width", [20, 200])
def test_suffixes(docs, empty, width):
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    count = Counter(d[i : i + width] for _, d in rows for i in range(len(d) - width + 1))
    want = []
    for i, d in rows:
        kept, spans = slow_cut(d, count, width)
        want.append((i, len(d), len(d) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    found = suffix.removal_report(docs, width=width)
    assert Counter(map(tuple, found.collect())) == Counter(want)
    cut = suffix.without_repeats(docs, width=width)
    assert cut.columns == docs.columns and cut.count() == len(rows)
    assert Counter((r.doc_id, r.text or "") for r in cut.collect()) == Counter((i, slow_cut(d, count, width)[0].decode("utf-8", "ignore")) for i, d in rows)
    assert not suffix.removal_report(empty, width=width).collect()


def test_suffixes_of_edited_copies(spark):
    rng = random.Random(2)
    passage = sentence(rng, 150)
    texts = [passage]
    for _ in range(12):
        at = rng.randrange(len(passage))
        texts.append(sentence(rng, 5) + passage[: at - 1] + "#" + passage[at:] + sentence(rng, 5))
    texts.append(passage[100:420])
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    data = [t.encode() for t in texts]
    count = Counter(d[i : i + 200] for d in data for i in range(len(d) - 199))
    for r in suffix.removal_report(frame).collect():
        assert r.kept_sha256 == hashlib.sha256(slow_cut(data[r.doc_id], count, 200)[0]).hexdigest()


def test_repeated_rows(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 60) if rng.random() < 0.7 else 7, rng.randint(0, 2), i) for i in range(400)]
    found = repeated_rows(Scratch(spark), spark.createDataFrame(rows, "a long, b long, i long"), [["a"], ["a", "b"]], ["i"], "t").collect()
    one, two = Counter(r[0] for r in rows), Counter(r[:2] for r in rows)
    assert sorted((r.a, r.b, r.i, r.dup1) for r in found) == sorted((a, b, i, two[a, b] > 1) for a, b, i in rows if one[a] > 1)


def slow_mix(rows, weights):
    size = Counter()
    for _, t, s in rows:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped = set()
    while True:
        rest = sum(w[s] for s in order if s not in capped)
        level = Fraction(sum(size.values()) - sum(3 * size[s] for s in capped), rest)
        more = {s for s in order if s not in capped and w[s] * level > 3 * size[s]}
        if not more:
            return size, {s: 3 * size[s] if s in capped else w[s] * level for s in order}
        capped |= more


def test_mixing(docs, empty):
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    size, target = slow_mix(rows, [1, 2, 3])
    assert any(target[s] == 3 * size[s] for s in size if size[s])
    found = mixing.mix(docs, [1, 2, 3]).collect()
    assert sorted(map(str, found)) == sorted(map(str, mixing.mix(docs.repartition(5), [1, 2, 3]).collect())) and len(found) == len(rows)
    source = {(r.doc_id, r.source) for r in docs.collect()}
    by = dict(source)
    taken, largest = Counter(), Counter()
    for r in found:
        s = by[r.doc_id] if r.doc_id is not None else {0: "é"}.get(r.size, None)
        assert abs(r.target - target[s]) < 1e-6 * (1 + r.target) and r.source_size == size[s] and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    assert all(abs(taken[s] - target[s]) <= 3 * largest[s] / 2 for s in size)
    assert Counter(r.doc_id for r in mixing.repeat_by_mix(docs, [1, 2, 3]).collect())[5] == next(r.taken // r.size for r in found if r.doc_id == 5)
    assert not mixing.mix(empty, [1, 2, 3]).collect()


@pytest.mark.parametrize("n", [1, 8, 5000])
def test_shards(docs, empty, n):
    found = sharding.shards(docs, n).collect()
    want = [(r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect()]
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter(want)
    order = sorted(found, key=lambda r: (r.shard, r.slot))
    ids = [-1 if r.doc_id is None else r.doc_id for r in order]
    assert ids == sorted(ids)
    total, before = sum(r.size for r in found), 0
    for r in order:
        assert r.shard == (2 * before + r.size) * n // (2 * total)
        before += r.size
    for k in {r.shard for r in found}:
        assert [r.slot for r in order if r.shard == k] == list(range(sum(r.shard == k for r in found)))
    assert not sharding.shards(empty, n).collect()


def test_bpe(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(bpe, "_block_limit", 3000)
    monkeypatch.setattr(bpe, "_CHUNK", 500)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.share_ranks(spark, path)
    coder = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    more = spark.createDataFrame([(900, "it's  we'll\n\n  x\r\n\t<|endoftext|> 12 345,67 ça\u3000va \u0301\u00a0!", None, None, 1, 1, None)], DOCS)
    table = docs.unionByName(more)
    encoded = bpe.encode(table, ranks, public_tokenizers.PATTERN)
    want = Counter((r.doc_id, tuple(coder.encode_ordinary(r.text or "")), r.text or "") for r in table.collect())
    assert Counter((r.doc_id, tuple(r.ids)) for r in encoded.collect()) == Counter({(a, b): 0 for a, b, _ in want}) + Counter(x[:2] for x in want.elements())
    assert Counter((r.doc_id, bytes(r.decoded).decode()) for r in bpe.decode(encoded, ranks).collect()) == Counter((a, c) for a, _, c in want.elements())
    for r in bpe.digests(table, ranks, public_tokenizers.PATTERN, keep_ids=True).collect():
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()
    assert not bpe.encode(empty, ranks, public_tokenizers.PATTERN).collect()


def test_chat(spark):
    turns = [(0, 0, "system", "S"), (0, 1, "user", "Hi"), (0, 2, "assistant", "good"), (0, 3, "user", "and?"), (0, 4, "assistant", "fine"), (1, 0, "system", "S"), (1, 1, "user", "Hi"), (1, 2, "assistant", "bad <|im_end|>"), (2, 0, "user", "alone"), (5, None, None, None), (None, 0, "user", "lost"), (6, 0, "user", "same"), (7, 0, "user", "same")]
    found = {r.pair_id: r for r in chat.preferences(chat.neighbour_pairs(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))).collect()}
    show = lambda r, t: f"<|im_start|>{r}\n{t}<|im_end|>\n"
    r = found[0]
    assert (r.n_prompt_turns, r.prompt) == (2, show("system", "S") + show("user", "Hi"))
    assert r.chosen_text == show("assistant", "good") + show("user", "and?") + show("assistant", "fine")
    assert [r.chosen_text[slice(*map(int, s.split(":")))] for s in r.chosen_spans.split(",")] == ["good<|im_end|>\n", "fine<|im_end|>\n"]
    assert r.rejected_text == show("assistant", "bad < |im_end|>")
    assert (found[1].prompt, found[1].chosen_text, found[1].rejected_text, found[1].chosen_spans) == ("", show("user", "alone"), "", "")
    assert found[2].rejected_text == show("user", "") and set(found) == {0, 1, 2, 3}
    assert (found[3].n_prompt_turns, found[3].chosen_text, found[3].rejected_text) == (1, "", "")


def slow_chat(rows):
    """(pair_id, n, prompt, chosen, rejected) of each conversation by plain lists."""
    by, show = defaultdict(list), lambda ts: "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in ts)
    for c, n, r, t in rows:
        if c is not None:
            by[c].append(((n is not None, n or 0), ("user" if r is None else r).replace("<|", "< |"), (t or "").replace("<|", "< |")))
    by = {c: [x[1:] for x in sorted(v)] for c, v in by.items()}
    last = {c: max((i for i, (r, _) in enumerate(v) if r == "assistant"), default=None) for c, v in by.items()}
    for c, own in by.items():
        far = c ^ 1
        other = own[: last[c]] + [by[far][last[far]]] if last[c] is not None and last.get(far) is not None else []
        n = next((i for i, (a, b) in enumerate(zip(own, other)) if a != b), min(len(own), len(other)))
        yield c, n, show(own[:n]), show(own[n:]), show(other[n:])


def test_chat_of_swapped_answers(spark):
    rng = random.Random(6)
    rows = [(c, n, rng.choice(["user", "assistant", "system", None]), rng.choice(["a", "b", "<|im_end|>", None, "é✓"])) for c in range(40) for n in range(rng.randint(1, 5))]
    rows += [rows[0], (41, None, "assistant", "x"), (40, 0, "user", "q"), (40, 1, "assistant", "x"), (40, 2, "user", "bye"), (None, 0, "assistant", "lost"), (60, 0, "assistant", "alone"), (-3, 0, "assistant", "left"), (-4, 0, "assistant", "right"), (50, 0, "user", "u" * 300_000), (51, 0, "assistant", "v")]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, pair_id string, turns int").repartition(3)
    found = chat.preferences(chat.swapped_answers(frame)).collect()
    assert Counter((r.pair_id, r.n_prompt_turns, r.prompt, r.chosen_text, r.rejected_text) for r in found) == Counter(slow_chat(rows))
    assert sum(r.n_prompt_turns > 0 for r in found) > 5
    for r in found:
        for text, spans in ((r.chosen_text, r.chosen_spans), (r.rejected_text, r.rejected_spans)):
            assert [text[slice(*map(int, s.split(":")))] for s in spans.split(",") if s] == re.findall(r"(?s)<\|im_start\|>assistant\n(.*?<\|im_end\|>\n)", text)
    assert chat.preferences(chat.swapped_answers(frame.limit(0))).collect() == []


def test_warc(spark, tmp_path):
    big, small = "<p>é" + "x" * 1200, "tiny\r\n\r\nWARC/1.1\r\nContent-Length: 9\r\n\r\n"
    rows = [(1, "http://a/\r\nX: y", big), (2, "http://b/", big), (3, None, small), (4, "u", small), (5, "v", None), (6, "v", ""), (7, "w", "x" * 1000), (2, "http://b/", big), (None, "n", big)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, n int")
    path = str(tmp_path / "a")
    warc.write_archive(pages, path)
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    found = warc.read_archive(spark, path).collect()
    assert Counter((r.page_id, bytes(r.payload).decode()) for r in found) == Counter((r[0], r[2] or "") for r in rows)
    kinds = Counter((r.page_id, r.record_type, r.refers_to) for r in found)
    assert kinds == Counter([(1, "revisit", 2), (2, "response", None), (2, "revisit", 2), (None, "revisit", 2), *[(i, "response", None) for i in (3, 4, 5, 6, 7)]])
    ids = [h.split("WARC-Record-ID: ")[1].split("\r\n")[0] for h in (r.header for r in found)]
    assert len(set(ids)) == len(rows)
    answers = {i for i, r in zip(ids, found) if r.record_type == "response"}
    assert all(r.header.split("WARC-Refers-To: ")[1].split("\r\n")[0] in answers for r in found if r.record_type == "revisit")
    only = spark.createDataFrame([(None, "u", big, "x"), (None, "u", big, "x")], "page_id long, url string, html string, sha256 string")
    warc.write_archive(only, str(tmp_path / "n"))
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in warc.read_archive(spark, str(tmp_path / "n")).collect()) == Counter([(None, "response", None), (None, "revisit", None)])
    assert all(r.payload_digest == hashlib.sha1(bytes(r.payload)).hexdigest() and r.payload_bytes == len(r.payload) for r in found)
    warc.export_warc(spark, path, str(tmp_path / "w"))
    parsed = warc.parse_warc(spark, str(tmp_path / "w")).collect()
    assert Counter((p.header, bytes(p.block)) for p in parsed) == Counter((r.header, b"" if r.record_type == "revisit" else bytes(r.payload)) for r in found)
    warc.write_archive(pages.limit(0), str(tmp_path / "e"))
    assert not warc.read_archive(spark, str(tmp_path / "e")).collect()


def test_damaged_payload_is_found(spark, tmp_path):
    path = str(tmp_path / "a")
    warc.write_archive(spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string"), path)
    bad = spark.createDataFrame([r.asDict() | {"payload": b"tex_"} for r in spark.read.parquet(f"{path}/payloads").collect()], spark.read.parquet(f"{path}/payloads").schema)
    bad.write.mode("append").parquet(f"{tmp_path}/b/payloads")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{tmp_path}/b/headers")
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_archive(spark, f"{tmp_path}/b").select("page_id", "payload_digest").collect()
    swapped = spark.read.parquet(f"{path}/headers").withColumn("header", F.replace("header", F.lit("sha1:"), F.lit("sha1:0")))
    swapped.write.parquet(f"{tmp_path}/c/headers")
    spark.read.parquet(f"{path}/payloads").write.parquet(f"{tmp_path}/c/payloads")
    with pytest.raises(Exception, match="damaged record"):
        warc.read_archive(spark, f"{tmp_path}/c").select("payload_digest").collect()
