"""The pipeline's stages against brute force, stage by stage."""

import base64
from collections import Counter

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline as cp
from millrace.llm import bpe, toxicity

from .test_neardup import brute as brute_groups
from .test_text_jobs import brute_leaks

PATH = "/root/testdata/sf0.01"


def test_stages(spark):
    raw = spark.read.parquet(f"{PATH}/documents.parquet")
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{PATH}/labels.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{PATH}/benchmark.parquet").collect()]
    docs, seen = raw, {}
    for name, stage in cp.STAGES:
        docs = cp.materialise(stage(spark, docs, PATH), name)
        seen[name] = docs.collect()
        assert docs.columns == raw.columns or name == "byte_bpe"
    before = raw.collect()
    table = Counter((toxic.get(r.doc_id), r.doc_id in {k.doc_id for k in seen["toxicity"]}) for r in before)
    assert table[0, False] <= 0.02 * (table[0, False] + table[0, True]) and table[1, False] > 0.5 * (table[1, False] + table[1, True])

    first = {}
    for r in sorted(seen["toxicity"], key=lambda r: r.doc_id):
        first.setdefault(r.text or "", r.doc_id)
    assert sorted(r.doc_id for r in seen["exact_dedup"]) == sorted(first.values())
    groups = brute_groups([(r.doc_id, r.text) for r in seen["exact_dedup"]])
    assert sorted(r.doc_id for r in seen["minhash"]) == [g[0] for g in groups if g[3]]
    short = [(r.doc_id, r.text) for r in seen["minhash"] if len((r.text or "").split()) < 300]
    held = {d for d, *_ in brute_leaks(short, items)}
    kept = {r.doc_id for r in seen["decontamination"]}
    assert {d for d, _ in short} - held == kept & {d for d, _ in short}

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    enc = tiktoken.Encoding("reference", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pairs, special_tokens={})
    texts = {r.doc_id: r.text or "" for r in seen["decontamination"]}
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in seen["byte_bpe"]} == {d: enc.encode_ordinary(t) for d, t in texts.items()}


def test_run(spark):
    out = cp.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"] and 0 < out.count() < 200


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{PATH}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    out = cp.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"] and out.count() == 0
    docs, labels = (spark.read.parquet(f"{tmp_path}/{n}.parquet") for n in ("documents", "labels"))
    assert toxicity.score(docs, toxicity.train(docs, labels.select("doc_id", "toxic"))).count() == 0
