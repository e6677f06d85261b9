"""Periodic runs, near-duplicate vectors and phrases against brute force."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from millrace.llm import periodic, phrases, vectors
from millrace.llm.queries import ORACLES, QUERIES

from ..compare import compare, connect

PATH = "/root/testdata/sf0.001"


# Periodic runs


def runs_of(words, least=24, times=3):
    """All runs by trying every period at every start."""
    n, out = len(words), []
    for p in range(1, n):
        i = 0
        while i + p < n:
            s = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            length = i - s + p
            if i > s and length >= max(least, times * p):
                smaller = any(all(words[s + k] == words[s + k + q] for k in range(length - q)) for q in range(1, p))
                if not smaller:
                    out.append((s, length, p))
            i = max(i, s + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(words, runs):
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("least, times", [(24, 3), (6, 2), (9, 3), (4, 2), (12, 4)])
def test_runs_of_random_words(least, times):
    rng = np.random.default_rng(least)
    for _ in range(40):
        docs = []
        for _ in range(int(rng.integers(1, 5))):
            w = rng.integers(0, rng.integers(1, 5) + 1, int(rng.integers(0, 140)))
            if len(w) and rng.random() < 0.7:
                p, a = int(rng.integers(1, 12)), int(rng.integers(0, len(w)))
                w = np.array([w[a + (i - a) % p] if i >= a and a + (i - a) % p < len(w) else w[i] for i in range(len(w))])
            docs.append(w)
        begin = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
        words = np.concatenate(docs).astype(np.uint64) * periodic.window_hashes(np.ones(1, np.uint64), 1)
        got = list(zip(*[x.tolist() for x in periodic.word_runs(words, begin, least, times)], strict=True))
        assert got == [(s + int(begin[i]), length, p) for i, d in enumerate(docs) for s, length, p in runs_of(list(d), least, times)]


def test_runs_of_defined_cases(rows, monkeypatch):
    monkeypatch.setattr(periodic, "PIECE_BYTES", 1 << 20)
    long = " ".join(["x", "y", "z"] * 30_000)
    texts = [None, "", " \t\n", "one", "a " * 23, "a " * 24, "\ta\n" * 30 + "b", "é è " * 20 + "end", long, "p q r " * 9 + "s " + "p q r " * 9, "a " * 24]
    data = [(None if i == 2 else i % 9, t, "clash", 1) for i, t in enumerate(texts)]
    frame = rows("doc_id long, text string, collapsed string, runs int", *data)
    got = sorted(((r.doc_id is None, r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.find_runs(frame).collect()), key=str)
    want = []
    for i, t, *_ in data:
        words = split(t)
        runs = [(0, 90_000, 3)] if t == long else runs_of(words)
        want.append((i is None, i, len(words), runs, collapse(words, runs)))
    assert got == sorted(want, key=str)
    assert periodic.find_runs(rows("doc_id long, text string")).count() == 0


def test_op11_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{PATH}/documents.parquet").collect() if len(split(r.text)) < 1500}
    got = {r.doc_id: r for r in QUERIES["op11_periodic_runs"](spark, PATH).collect()}
    assert len(got) == 200
    planted = 0
    for doc_id, text in docs.items():
        words = split(text)
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            planted += 1
        runs = runs_of(words)
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
        row = got[doc_id]
        assert (row.n_runs, row.start, row.length, row.period) == (len(runs), *best)
        assert row.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert row.runs_sha256 == hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(collapse(words, runs).encode()).hexdigest()
    assert planted > 5


# Vectors


def brute(x, least=0.9):
    """Links and smallest reachable row by all pairs; None for rows that cannot link."""
    dim = max((len(v) for v in x if v), default=0)
    m = np.zeros((len(x), dim))
    for i, v in enumerate(x):
        if v and all(c is not None and np.isfinite(c) for c in v):
            m[i, : len(v)] = v
    norm = np.linalg.norm(m, axis=1)
    ok = norm > 0
    m[ok] /= norm[ok, None]
    near = (m @ m.T >= least) & ok[:, None] & ok[None, :]
    np.fill_diagonal(near, False)
    lead = np.arange(len(x))
    for _ in range(len(x)):
        new = np.where(near, lead[None, :], len(x)).min(axis=1, initial=len(x))
        new = np.minimum(lead, new)
        if (new == lead).all():
            break
        lead = new
    return near, lead


def frame_of(rows, x):
    return rows("vec_id long, embedding array<float>, component_id string, n_links int", *[(i, v, "clash", 7) for i, v in enumerate(x)])


def turned(rng, base, cosine):
    v = rng.standard_normal(len(base))
    v -= v @ base * base
    return cosine * base + np.sqrt(1 - cosine**2) * v / np.linalg.norm(v)


def as32(m):
    return [np.float32(v).astype(float).tolist() for v in m]


def test_links_at_the_threshold_are_found(rows):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((1200, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    x = as32([*base, *[turned(rng, b, c) for b, c in zip(base, np.linspace(0.89, 0.94, 1200), strict=True)]])
    near, _ = brute(x)
    got = {r.vec_id: r.n_links for r in vectors.group_near_vectors(frame_of(rows, x)).collect()}
    links = near.sum(axis=1)
    assert all(got[i] <= n for i, n in enumerate(links))
    assert sum(got.values()) >= 0.99 * links.sum()


@pytest.mark.parametrize("block, held", [(2048, 8192), (64, 100)])
def test_hot_groups_of_vectors(rows, block, held):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((120, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    tight = [turned(rng, base[0], c) for c in rng.uniform(0.985, 0.999, 300)]
    wide = [turned(rng, base[1], c) for c in rng.uniform(0.93, 0.97, 80)]
    rim = [turned(rng, tight[i], c) for i, c in enumerate(rng.uniform(0.88, 0.95, 60))]
    x = as32([*base, *tight, *wide, *rim, *[tight[0]] * 40])
    near, lead = brute(x)
    got = {r.vec_id: r for r in vectors.group_near_vectors(frame_of(rows, x), block=block, held=held).collect()}
    links = near.sum(axis=1)
    assert all(got[i].n_links <= n for i, n in enumerate(links))
    assert sum(r.n_links for r in got.values()) >= 0.99 * links.sum()
    assert [got[i].component_id for i in range(len(x))] == lead.tolist()
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_vectors_of_defined_cases(rows):
    nan, inf = float("nan"), float("inf")
    x = [None, [], [0.0, 0.0], [1.0, None], [nan, 1.0], [inf, 1.0], [1.0, 2.0], [2.0, 4.0], [1.0, 2.0, 0.0], [2.0, 3.9, 0.1], [-1.0, -2.0], [5.0], [1.0, 2.0]]
    near, lead = brute(x)
    got = sorted(tuple(r) for r in vectors.group_near_vectors(frame_of(rows, x)).collect())
    assert got == [(i, int(near[i].sum()), int(lead[i]), bool(lead[i] == i)) for i in range(len(x))]
    named = rows("vec_id long, embedding array<float>", (None, [1.0, 0.0]), (7, [1.0, 0.0]), (7, [2.0, 0.0]), (None, [0.0, 1.0]), (None, None))
    got = sorted((tuple(r) for r in vectors.group_near_vectors(named).collect()), key=str)
    assert got == sorted([(None, 2, 7, False), (7, 2, 7, True), (7, 2, 7, True), (None, 0, None, False), (None, 0, None, False)], key=str)
    assert vectors.group_near_vectors(rows("vec_id long, embedding array<float>")).count() == 0
    assert vectors.group_near_vectors(rows("vec_id long, embedding array<float>", (1, None))).collect()[0].kept


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((400, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = np.array([turned(rng, v, 0.9) for v in x])
    code, factor, _, _ = vectors.encode(x)
    _, _, q, scale = vectors.encode(y)
    error = np.diagonal(vectors.estimate(code, factor, q, scale)) - 0.9
    bound = np.diagonal(vectors.error_bound(factor, scale, np.full((400, 400), np.sqrt(1 - 0.81)), 64))
    assert abs(error.mean()) < 0.01
    assert (np.abs(error) <= bound).all()


# Phrases


def mined(docs, least, words=4, top=2000, cover=80):
    """Counts of every phrase, then the rules as stated."""
    f, total = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, words + 1):
                f.update((lang, *w[i : i + n]) for i in range(len(w) - n + 1))
    candidates = {p: a for p, a in f.items() if a >= least and len(p) > 2}
    out = []
    for p, a in candidates.items():
        lang, w = p[0], p[1:]
        held = any(q[0] == lang and len(q) > len(p) and any(q[1 + i : 1 + i + len(w)] == w for i in range(len(q) - len(p) + 1)) and 100 * b >= cover * a for q, b in candidates.items())
        if not held:
            cuts = [(2_000_000 * a // (f[(lang, *w[:k])] + f[(lang, *w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            out.append((lang, " ".join(w), a, f[(lang, *w[:k])], f[(lang, *w[k:])], total[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    return [(lang, rank, *rest) for lang, group in itertools.groupby(out, key=lambda r: r[0]) for rank, (_, *rest) in enumerate(itertools.islice(group, top), 1)]


@pytest.mark.parametrize("share, top", [(0.25, 2000), (0.0, 5), (1.0, 2000)])
def test_phrases_whatever_the_sample(rows, share, top):
    rng = np.random.default_rng(9)
    vocabulary = ["the", "The", "red", "fox", "a", "über", "x-1", "end"]
    texts = [(["en", "de", None][i % 3], "".join(f"{vocabulary[k]}{[' ', ' ', '  ', chr(9), '. ', chr(10)][int(rng.integers(6))]}" for k in rng.integers(0, 8, int(rng.integers(0, 60))))) for i in range(60)]
    texts += [("en", None), ("en", ""), (None, " . "), ("fr", "one two"), texts[0], texts[0], ("de", "the red fox the red fox " * 2000)]
    frame = rows("lang string, text string, phrase string, f int", *[(a, b, "clash", 1) for a, b in texts])
    got = sorted(tuple(r) for r in phrases.collocations(frame, least=8, top=top, share=share).collect())
    assert got == sorted(mined(texts, 8, top=top))
    assert phrases.collocations(rows("lang string, text string")).count() == 0


@pytest.mark.parametrize("name", ["op12_embedding_dedup", "op13_collocations"])
def test_queries_equal_their_sql(spark, name):
    assert compare(spark, connect(PATH), PATH, QUERIES[name], ORACLES[name]) == ""
