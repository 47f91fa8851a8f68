"""The pipeline's stages, each against brute force on what the one before kept."""

import hashlib
import os
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import types as T
from test_operators import slow_cut, slow_failed, slow_mix, slow_posteriors
from test_similar import slow_kept

import corpus_pipeline
from ordkv.llm import bpe
from ordkv.llm.common import shared_root

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def check_stages(spark, docs):
    """Each stage against brute force on what the one before kept; what each kept."""
    columns, given, kept = docs.columns, docs.collect(), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        kept[name] = docs.collect()
        assert name == "bpe_encoding" or docs.columns == columns, name

    good = [r for r, p in zip(given, slow_posteriors([r.text for r in given])) if p >= 0.5 and not slow_failed(r.text)]
    assert Counter(kept["quality_rules"]) == Counter(good)

    ids = {r.doc_id for r in kept["simhash_dedup"]}
    numbered = [((r.doc_id is None, r.doc_id or 0), r.text) for r in kept["quality_rules"]]
    assert {(i is None, i or 0) for i in ids} == slow_kept(sorted(set(numbered))) and len(ids) == len(kept["simhash_dedup"])

    data = {r.doc_id: r.text.encode() for r in kept["simhash_dedup"]}
    count = Counter(d[i : i + 200] for d in data.values() for i in range(len(d) - 199))
    want = {i: slow_cut(d, count, 200)[0].decode("utf-8", "ignore") for i, d in data.items()}
    assert {r.doc_id: r.text for r in kept["suffix_dedup"]} == want
    before = {r.doc_id: r for r in kept["simhash_dedup"]}
    assert all(r.n_chars == (before[r.doc_id].n_chars if r.text == before[r.doc_id].text else len(r.text)) for r in kept["suffix_dedup"])

    size, target = slow_mix([(r.doc_id, r.text, r.source) for r in kept["suffix_dedup"]], [1, 2, 3])
    words, taken, largest = {r.doc_id: len(r.text.split()) for r in kept["suffix_dedup"]}, Counter(), Counter()
    for r in kept["suffix_dedup"]:
        largest[r.source] = max(largest[r.source], words[r.doc_id])
    for r in kept["source_mixing"]:
        taken[r.source] += words[r.doc_id]
    assert max(Counter(r.doc_id for r in kept["source_mixing"]).values(), default=0) <= 3
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 for s in size)

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coder = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    ids = Counter((r.doc_id, tuple(coder.encode_ordinary(r.text))) for r in kept["source_mixing"])
    assert Counter((r.doc_id, tuple(r.ids)) for r in kept["bpe_encoding"]) == ids
    for r in kept["bpe_encoding"]:
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest() and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(coder.decode_bytes(r.ids)).hexdigest()
    return kept


@tables
def test_stages(spark):
    check_stages(spark, spark.read.parquet(f"{SF}/documents.parquet"))


@tables
def test_stages_on_odd_rows(spark):
    """Nulls in any column, empty texts, repeated rows, ties, and further columns whose names the operators use."""
    some = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    rows = [tuple(r) for r in some.collect()]
    rows += [rows[5], rows[5], rows[9], (None, rows[20][1], None, None, None), (None, None, None, None, None), (900, None, "en", "web", 0), (901, "", "en", "web", 0), (902, " \n\t", "en", None, 3), (903, rows[30][1], None, None, None)]
    extra = ["ids", "doc", "mark", "label", "text_hash", "__doc", "u", "copies", "a.b"]
    wide = spark.createDataFrame([(*r, *[f"x{i}" for i in range(len(extra))]) for r in rows], T.StructType([*some.schema.fields, *[T.StructField(c, T.StringType()) for c in extra]])).repartition(3)
    kept = check_stages(spark, wide)
    assert all(r[c] == f"x{i}" for r in kept["source_mixing"] for i, c in enumerate(extra))


@tables
def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).collect() == [], name


@tables
def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"] and out.count() > 0


@tables
def test_run_keeps_only_its_result(spark):
    root = shared_root(spark).removeprefix("file://")
    before = set(os.listdir(root))
    out = corpus_pipeline.run(spark, SF)
    (left,) = set(os.listdir(root)) - before
    assert [n.split("-")[1] for n in os.listdir(f"{root}/{left}")] == ["bpe_encoding"] and out.count() > 0
