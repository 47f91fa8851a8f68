"""Near-duplicates by shingle similarity against brute force."""

import os
import random

import numpy as np
import pytest
from test_operators import components, sentence

import corpus_pipeline
from ordkv.llm import similar, simhash
from ordkv.llm.common import Scratch, connected_components

SF = "/root/testdata/sf0.01"


def slow_set(text, size=5):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set()


def alike(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def slow_kept(rows):
    s = {i: slow_set(t) for i, t in rows}
    return set(components(s, [(a, b) for a in s for b in s if a < b and alike(s[a], s[b])]).values())


@pytest.mark.parametrize(("limit", "seen"), [(1, 1), (3, 2), (16, 4)])
def test_links_are_complete(spark, monkeypatch, limit, seen):
    monkeypatch.setattr(similar, "SAMPLE", 1 if seen < 4 else similar.SAMPLE)
    monkeypatch.setattr(similar, "SEEN", seen)
    rng = random.Random(limit)
    rows = []
    for _ in range(4):
        words = sentence(rng, 90).split()
        for _ in range(25):
            w = list(words)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = sentence(rng, 1)
            rows.append(" ".join(w + sentence(rng, rng.randint(0, 9)).split()[: rng.randint(0, 9)]))
    shared = sentence(rng, 30)
    rows += [f"{shared} {sentence(rng, n)}" for n in range(1, 40)] + ["", None, "one", "ONE", "a b c d", "a b c d e", rows[0].upper(), rows[0]]
    made = similar.sets(Scratch(spark), spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3))
    cid = {r.doc_id: r.cid for r in made.rows.collect()}
    found = {r.node: r.component for r in connected_components(Scratch(spark), similar.links(Scratch(spark), made, 80, limit)).collect()}
    s = [slow_set(t) for t in rows]
    want = components(range(len(rows)), [(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if alike(s[a], s[b])])
    label = {i: found.get(c, c) for i, c in cid.items()}
    assert all((label[a] == label[b]) == (want[a] == want[b]) for a in want for b in want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stage_keeps_one_of_similar_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.simhash_dedup(spark, docs, SF)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == slow_kept([(r.doc_id, r.text) for r in docs.collect()])
    assert not corpus_pipeline.simhash_dedup(spark, docs.limit(0), SF).collect()


def test_segments_are_the_simhash():
    text = " ".join(f"w{i}" for i in range(700))
    h = similar.shingles(text).view(np.uint64)
    segs, flips = simhash.segments(h, 16)
    assert len(segs) == len(flips) == 32
    assert sum(int(segs[i]) << 16 * i for i in range(4)) == simhash.fingerprint(text, 5)
    for i in range(4):
        over = [abs(2 * sum(int(x) >> b & 1 for x in h) - len(h)) for b in range(16 * i, 16 * i + 16)]
        assert int(flips[i]).bit_count() == 2 and sum(o for b, o in enumerate(over) if int(flips[i]) >> b & 1) == sum(sorted(over)[:2])


def test_simhash_tables_find_near_copies(spark):
    """Without the exact pass: pairs from 0.8 to 0.95, and none below 0.8."""
    rng, rows = random.Random(7), []
    for _ in range(250):
        w = [f"w{rng.randrange(3000)}" for _ in range(150)]
        rows.append(" ".join(w))
        for at in rng.sample(range(20, 130), rng.randint(1, 4)):
            w[at] = "other"
        rows.append(" ".join(w))
    made = similar.sets(Scratch(spark), spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3))
    doc = {r.cid: r.doc_id for r in made.rows.collect()}
    found = {tuple(sorted((doc[r.a], doc[r.b]))) for r in similar.near_links(Scratch(spark), made).collect()}
    s = [slow_set(t) for t in rows]
    want = {(i, i + 1) for i in range(0, len(rows), 2) if alike(s[i], s[i + 1])}
    assert found <= want and 150 < len(want) < 250 and len(found) >= 0.98 * len(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stage_gets_its_rows_by_simhash(spark, monkeypatch):
    monkeypatch.setattr(similar, "_missed", lambda scratch, made, found, least: found)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    copy = [(1_000_000 + i, " ".join(w[:-2] + ["other", "words"])) for i, t in rows for w in [(t or "").split()] if len(w) > 100][:200]
    more = docs.unionByName(spark.createDataFrame(copy, "doc_id long, text string"), allowMissingColumns=True)
    assert {r.doc_id for r in corpus_pipeline.simhash_dedup(spark, more, SF).collect()} == slow_kept(rows + copy)
