"""Removal of repeated strings against a dictionary of all of them."""

import hashlib
import random

import pytest

from millrace.llm import suffix
from millrace.llm.queries import QUERIES


def brute(data, n=50):
    first = {}
    data = sorted(((1 << 70 if d is None else d, (t or "").encode(), d) for d, t in data), key=lambda x: x[0])
    for d, raw, _ in data:
        for i in range(len(raw) - n + 1):
            first.setdefault(raw[i : i + n], d)
    out = []
    for d, raw, shown in data:
        gone = bytearray(len(raw))
        for i in range(len(raw) - n + 1):
            if first[raw[i : i + n]] != d:
                gone[i : i + n] = b"\1" * n
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((str(shown), len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((str(r.doc_id), r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in df.collect())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_tables(spark, sf):
    path = f"/root/testdata/{sf}"
    data = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    df = QUERIES["op1_suffix_dedup"](spark, path)
    assert df.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_removed", "bigint"), ("n_spans", "bigint"), ("kept_sha256", "string")]
    assert sorted((str(r[0]), *r[1:]) for r in df.collect()) == brute(data)


def made(seed):
    """Texts over few letters, so strings of every overlap repeat, with shared pieces of all lengths around the threshold."""
    rng = random.Random(seed)
    word = lambda n, letters="abé ": "".join(rng.choice(letters) for _ in range(n))
    shared = [word(n) for n in (30, 48, 49, 50, 51, 60, 84, 90, 200)] + ["ab" * 60, "x" * 120, "abc" * 70]
    data = []
    for i in range(90):
        parts = []
        for _ in range(rng.randrange(0, 6)):
            s = rng.choice(shared)
            a = rng.randrange(len(s))
            parts += [word(rng.randrange(0, 40)), rng.choice([s, s[a:], s[:a]])]
        data.append((i * 3, "".join(parts)))
    return [*data, (1000, None), (1001, ""), (1002, "é" * 25), (1003, "é" * 25), (None, shared[-2]), (None, shared[-4] + "tail")]


@pytest.mark.parametrize(("seed", "many"), [(1, 1 << 16), (2, 3)])
def test_made_texts(rows, monkeypatch, seed, many):
    monkeypatch.setattr(suffix, "MANY", many)
    data = made(seed)
    random.Random(seed).shuffle(data)
    frame = rows("doc_id long, text string, pos string, k string", *[(d, t, "clash", None) for d, t in data])
    assert got(suffix.remove_repeats(frame.repartition(5))) == brute(data)


def test_repeated_ids_and_long_texts(rows, monkeypatch):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefgh ") for _ in range(30_000))
    data = [(7, long), (7, long[500:900]), (7, long[500:900]), (8, long[500:900] + "new" + long[20_000:21_000]), (9, long), (3, long[100:160])]
    frame = rows("doc_id long, text string", *data)
    want = brute(data)
    assert got(suffix.remove_repeats(frame)) == want
    assert got(suffix.remove_repeats(rows("doc_id long, text string"))) == []


def test_pieces_of_long_texts(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(4)
    raw = rng.integers(97, 101, 20_000).astype(np.uint8)
    whole = suffix._text_anchors(raw, np.array([0, len(raw)]))
    monkeypatch.setattr(suffix, "CHUNK_BYTES", 1000)
    pieces = suffix._text_anchors(raw, np.array([0, len(raw)]))
    assert all((a == b).all() for a, b in zip(whole, pieces, strict=True))


def shuffle_files(spark):
    """Name and bytes of the shuffle files on disk."""
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
    sizes = {}
    while found.hasNext():
        f = found.next()
        if f.getName().startswith("shuffle_"):
            sizes[f.getName()] = f.length()
    return sizes


def chance_repeats():
    """Texts that share 16 to 28 bytes with many others, between bytes of their own; two hold a longer passage."""
    rng = random.Random(5)
    own = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    shared = [own(n) for n in (16, 20, 24, 28)]
    data = [(i, "".join(own(40) + rng.choice(shared) for _ in range(30))) for i in range(60)]
    passage = own(70)
    return [*data, (100, own(90) + passage + own(45)), (101, own(33) + passage[8:] + own(10)), (102, passage[:50])]


def test_chance_repeats_are_not_compared(rows, monkeypatch):
    asked = []
    plain = suffix.materialise
    monkeypatch.setattr(suffix, "materialise", lambda df, label, *a, **b: asked.append((label, plain(df, label, *a, **b))) or asked[-1][1])
    data = chance_repeats()
    frame = rows("doc_id long, text string", *data)
    assert got(suffix.remove_repeats(frame.repartition(4))) == brute(data)
    marks = dict(asked)["marks"].filter("kind = 0")
    assert 0 < marks.count() < 30
    assert {r.doc for r in marks.select("doc").distinct().collect()} <= {100, 101, 102}


@pytest.mark.parametrize(("hold", "many"), [(4, 1 << 16), (4, 3), (1, 0)])
def test_crowded_buckets(rows, monkeypatch, hold, many):
    monkeypatch.setattr(suffix, "HOLD", hold)
    monkeypatch.setattr(suffix, "MANY", many)
    for data in (made(3), chance_repeats()):
        frame = rows("doc_id long, text string", *data)
        assert got(suffix.remove_repeats(frame.repartition(5))) == brute(data)


def test_few_buckets_and_small_batches(rows, spark, monkeypatch):
    """All anchors meet in a few buckets, each over many batches: the halves still tell them apart."""
    few = suffix._bucket
    monkeypatch.setattr(suffix, "_bucket", lambda rank: few(rank) & suffix.np.uint64(3))
    monkeypatch.setattr(suffix, "MANY", 1 << 30)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        for data in (made(4), chance_repeats()):
            assert got(suffix.remove_repeats(rows("doc_id long, text string", *data).repartition(3))) == brute(data)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_halves():
    """Anchors share a left half, a right half, or neither, with another document; cut-off halves match nothing."""
    import numpy as np

    key = lambda bucket, left, right: bucket << 40 | left << 20 | right
    rows = [(key(1, 5, 6), 1), (key(1, 5, 7), 2), (key(1, 8, 7), 2), (key(1, 9, 9), 3), (key(1, 0, 4), 1), (key(1, 0, 3), 2), (key(2, 5, 6), 4), (key(2, 5, 6), 4), (key(1, 1, 4), 5)]
    got = suffix._share_a_half(np.array([k for k, _ in rows], np.int64), np.array([d for _, d in rows], np.int64))
    assert got.tolist() == [True, True, False, False, True, False, False, False, True]


def test_shuffle_files_go_with_the_marks(spark):
    """The anchors' shuffle is gone before the comparison begins, without a collection of the driver's garbage."""
    import time

    before = shuffle_files(spark)
    df = QUERIES["op1_suffix_dedup"](spark, "/root/testdata/sf0.01")  # writes the marks, by a shuffle of 3 MB
    left = lambda: sum(n for name, n in shuffle_files(spark).items() if name not in before)
    for _ in range(50):
        if left() < 300_000:
            break
        time.sleep(0.1)
    assert left() < 300_000
    assert df.count() == 1000
