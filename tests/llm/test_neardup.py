"""Near-duplicate groups against all pairs."""

import random
import re
import sys

import pytest

from millrace.llm import neardup
from millrace.llm.components import connected_components
from millrace.llm.queries import QUERIES


def brute(data, words=5, percent=75):
    sets = {}
    for d, t in data:
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        sets[d] = {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    index = {}
    for d, s in sets.items():
        for x in s:
            index.setdefault(x, []).append(d)
    for a in sorted(sets):
        for b in {b for x in sets[a] for b in index[x] if b > a}:
            i = len(sets[a] & sets[b])
            if 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return sorted((d, len(sets[d]), find(d), find(d) == d) for d in sets)


def got(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_tables(spark, sf):
    path = f"/root/testdata/{sf}"
    data = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    assert got(QUERIES["op7_minhash"](spark, path)) == brute(data)


def test_chains_and_hot_groups(rows, monkeypatch):
    """Chains of small changes, a large group around the threshold, in blocks smaller than the group."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "SMALL", 24)
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(4000)]
    data, text = [], [rng.choice(vocabulary) for _ in range(120)]
    for i in range(40):  # a chain: neighbours are alike, ends are not
        text = text[:]
        for _ in range(2):
            text[rng.randrange(len(text))] = rng.choice(vocabulary)
        data.append((1000 - i, " ".join(text)))
    core = [rng.choice(vocabulary) for _ in range(100)]
    for i in range(120):  # a group whose pairs lie on both sides of the threshold
        own = core[:]
        for _ in range(rng.randrange(0, 5)):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        data.append((2000 + i, " ".join(own)))
    data += [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE  two"), (6, "one three"), (7, "a b c d e"), (8, "A b c d e")]
    frame = rows("doc_id long, text string, component_id string, n string", *[(d, t, "clash", None) for d, t in data])
    assert got(neardup.group_near_copies(frame)) == brute(data)


def test_repeats_nulls_and_empty(rows):
    schema = "doc_id long, text string"
    out = got(neardup.group_near_copies(rows(schema, (5, "a b c"), (5, "a b c"), (3, "A B C"), (9, "x" * 200_000))))
    assert out == [(3, 1, 3, True), (5, 1, 3, False), (5, 1, 3, False), (9, 1, 9, True)]
    assert {(r.doc_id, r.component_id, r.kept) for r in neardup.group_near_copies(rows(schema, (None, "a b"), (2, "a b"), (None, "c"))).collect()} == {
        (None, 2, False), (2, 2, True), (None, None, True)}
    assert neardup.group_near_copies(rows(schema)).collect() == []
    kept = neardup.keep_one_of_each(rows("doc_id long, text string, kept string", (5, "a b c", "p"), (3, "a b c", "q"), (4, None, None)))
    assert sorted(tuple(r) for r in kept.collect()) == [(3, "a b c", "q"), (4, None, None)]


def test_rows_that_share_an_id_or_have_none(rows):
    """Each text stands for itself: only the copies go, with their own rows."""
    rng = random.Random(9)
    long = [f"w{rng.randrange(900)}" for _ in range(80)]
    near = " ".join([*long[:40], "changed", *long[41:]])
    data = [(None, "a b"), (2, "a b"), (None, "c"), (None, None), (7, "one text of its own"), (7, "A  b"), (7, "another text of its own"),
            (None, near), (8, " ".join(long)), (8, "clean and apart"), (None, "d e"), (None, "D e")]
    frame = rows("doc_id long, text string, kept string", *[(d, t, "clash") for d, t in data])
    kept = neardup.keep_one_of_each(frame.repartition(3))
    assert kept.columns == ["doc_id", "text", "kept"]
    left = [(r.doc_id, r.text) for r in kept.collect()]
    ends = [t for t in left if t[0] is None and (t[1] or "").lower() == "d e"]
    gone = {(None, "a b"), (7, "A  b"), (None, near)}
    assert len(ends) == 1 and sorted(left, key=str) == sorted([t for t in data if t not in gone and t not in data[-2:]] + ends, key=str)


def test_components(rows):
    rng = random.Random(5)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i + 1, i) for i in range(1000, 1100)] + [(7, 7), (None, 3)]
    parent = {}
    sys.setrecursionlimit(10_000)

    def find(x):
        parent.setdefault(x, x)
        return x if parent[x] == x else find(parent[x])

    for a, b in links:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    out = {r.node: r.component for r in connected_components(rows("a long, b long", *links)).collect()}
    assert out == {x: find(x) for x in parent}
