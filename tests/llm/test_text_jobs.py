"""Line dedup, benchmark decontamination and toxicity against brute force and held-out rows."""

import random
import re
import time
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from millrace.llm import decontaminate, lines, toxicity
from millrace.llm.queries import ORACLES, QUERIES
from tests.compare import compare, connect

PATH = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, name):
    assert compare(spark, connect(PATH), PATH, QUERIES[name], ORACLES[name]) == ""


def brute_lines(data, run):
    order = sorted({((d is None, d or 0), t or "") for d, t in data})
    seen, out = set(), {}
    for key, t in order:
        rows = t.split("\n")
        gone = [False] * len(rows)
        for i in range(len(rows) - run + 1):
            window = tuple(rows[i : i + run])
            if window in seen:
                gone[i : i + run] = [True] * run
            seen.add(window)
        out[key, t] = "\n".join(r for r, g in zip(rows, gone) if not g), sum(gone)
    return sorted((str(d), *out[(d is None, d or 0), t or ""]) for d, t in data)


@pytest.mark.parametrize("run", [1, 2, 3, 5])
def test_lines(rows, run):
    rng = random.Random(run)
    data = [(i, "\n".join(rng.choice(["a", "b", "c", "hot", ""]) for _ in range(rng.randrange(0, 9)))) for i in range(120)]
    data += [(500, None), (501, ""), (502, "x\ny\nz\nx\ny\nz\nx"), (None, "x\ny\nz"), (502, "x\ny\nz\nx\ny\nz\nx"), (503, "hot\n" * 3000)]
    frame = rows("doc_id long, text string, doc string, runs string", *[(d, t, "clash", None) for d, t in data])
    got = lines.drop_repeated_lines(frame.repartition(4), run=run).collect()
    assert sorted((str(r.doc_id), r.kept, sum(s.end - s.start for s in r.runs)) for r in got) == brute_lines(data, run)
    assert lines.drop_repeated_lines(rows("doc_id long, text string")).collect() == []


def brute_long(data, run, words):
    """What stays of each text, and how many lines go, when lines of more than ``words`` words count by themselves."""
    seen, out = set(), {}
    for d, t in data:
        lines_ = t.split("\n")
        gone = set()
        for i, line in enumerate(lines_):
            if len(line.split()) > words:
                gone |= {i} if line in seen else set()
                seen.add(line)
            if i + run <= len(lines_):
                pair = tuple(lines_[i : i + run])
                gone |= set(range(i, i + run)) if pair in seen else set()
                seen.add(pair)
        out[d] = "\n".join(x for i, x in enumerate(lines_) if i not in gone), len(gone)
    return sorted((d, *out[d]) for d in out)


@pytest.mark.parametrize("run", [2, 3])
def test_long_lines(rows, run):
    rng = random.Random(run)
    pool = ["a", "b", "", "x y z", "one two three four", "one  two\tthree four ", " p q r s t", "four words\x0bthat stand"]
    data = [(i, "\n".join(rng.choice([*pool, f"own {i}"]) for _ in range(rng.randrange(1, 8)))) for i in range(150)]
    data += [(200, "only here before and after"), (201, "only here before and after"), (202, "u\nonly here before and after\nv")]
    got = lines.drop_repeated_lines(rows("doc_id long, text string", *data).repartition(4), run=run, alone=3).collect()
    assert sorted((r.doc_id, r.kept, sum(s.end - s.start for s in r.runs)) for r in got) == brute_long(data, run, 3)
    assert {r.doc_id: r.kept for r in got if r.doc_id >= 200} == {200: data[150][1], 201: "", 202: "u\nv"}


def brute_leaks(docs, items):
    words = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    out = []
    for d, text in docs:
        w = words(text)
        for i, item in items:
            x = words(item)
            if not w or not x:
                continue
            k, n = min(5, len(x)), min(len(w), len(x))
            if n < k:
                continue
            want = Counter(tuple(x[a : a + k]) for a in range(len(x) - k + 1))
            best = None
            for s in range(len(w) - n + 1):
                have = Counter(tuple(w[a : a + k]) for a in range(s, s + n - k + 1))
                value = (want & have).total() / (want | have).total()
                if value >= 0.75 and (best is None or value > best[2]):
                    best = (d, i, value, s, n)
            if best:
                out.append(best)
    return sorted(out, key=str)


def test_leaks_in_made_documents(rows, monkeypatch):
    monkeypatch.setattr(decontaminate, "SLICE_ITEMS", 7)
    rng = random.Random(8)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop") + str(rng.randrange(30))
    passage = lambda n: [word() for _ in range(n)]
    items = [(i, " ".join(passage(rng.randrange(5, 45)))) for i in range(20)] + [(50, "two words"), (51, None), (52, " "), (53, "la " * 30), (54, "one")]
    docs = []
    for d in range(60):
        parts = passage(rng.randrange(0, 60))
        for _ in range(rng.randrange(0, 3)):
            own = rng.choice(items[:20])[1].split()
            for _ in range(rng.choice([0, 0, 1])):
                own[rng.randrange(len(own))] = word()
            parts += [x.upper() if rng.random() < 0.2 else x for x in own[rng.choice([0, 0, 2]) :]] + passage(rng.randrange(0, 9))
        docs.append((d, "  ".join(parts)))
    docs += [(100, None), (101, ""), (102, "la " * 500), (103, items[3][1]), (104, "Two\twords"), (105, "two  words more"), (106, " ".join(items[5][1].split()[:-1]))]
    frame = rows("doc_id long, text string, item_id string", *[(d, t, "clash") for d, t in docs])
    table = rows("item_id long, text string", *items)
    got = sorted(((r.doc_id, r.item_id, r.similarity, r.start_word, r.n_words) for r in decontaminate.find_leaks(frame, table).collect()), key=str)
    assert got == brute_leaks(docs, items) and len(got) > 40
    kept = decontaminate.drop_leaks(frame, table)
    assert kept.columns == ["doc_id", "text", "item_id"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted({d for d, _ in docs} - {g[0] for g in got})
    assert decontaminate.find_leaks(frame, table.limit(0)).collect() == [] and decontaminate.find_leaks(frame.limit(0), table).collect() == []


def test_a_document_of_many_items_meets_each_where_it_stands():
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(20_000)}" for _ in range(20)) for _ in range(10_000)]
    index = decontaminate.Index(texts, decontaminate.SIMILARITY)
    begun = time.time()
    raw = np.frombuffer(" ".join(texts[:1000] + texts[:50]).encode(), np.uint8)
    words = decontaminate.word_hashes(raw, np.array([0, len(raw)]))[0]
    tracemalloc.start()
    found = index.search(words)
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
    assert found == [(i, 1.0, 20 * i, 20) for i in range(1000)]
    assert time.time() - begun < 30


def test_leaks_leave_other_texts_of_their_id(rows):
    item = "this passage of eight words is the benchmark"
    data = [(None, item), (None, "clean"), (None, None), (4, f"before {item} after"), (4, "clean too"), (4, None), (5, "clean")]
    frame = rows("doc_id long, text string, _key string", *[(d, t, "clash") for d, t in data])
    kept = decontaminate.drop_leaks(frame, rows("item_id long, text string", (1, item)))
    assert kept.columns == ["doc_id", "text", "_key"]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([t for t in data if item not in (t[1] or "")], key=str)


def test_leaks_in_tables(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{PATH}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{PATH}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in QUERIES["op6_decontaminate"](spark, PATH).collect()}
    exact = {(d, i) for d, t in docs for i, x in items if x in (t or "")}
    assert exact <= got
    short = [d for d in docs if len((d[1] or "").split()) < 700]
    assert {(d, i) for d, i, *_ in brute_leaks(short, items)} == {g for g in got if g[0] in {d for d, _ in short}}


def test_toxicity_held_out(spark):
    path = "/root/testdata/sf0.1"
    scored = QUERIES["op2_toxicity"](spark, path).join(spark.read.parquet(f"{path}/labels.parquet").select("doc_id", "toxic"), "doc_id")
    table = Counter((r.toxic, r.predicted) for r in scored.filter("held_out").collect())
    assert table[1, 1] >= 0.8 * (table[1, 1] + table[1, 0]) and table[0, 1] <= 0.02 * (table[0, 0] + table[0, 1])


def test_toxicity_changed_insults(rows):
    """Gaps, inserted characters and digits in place of letters; nulls, repeats, unknown labels."""
    rng = random.Random(2)
    syllables = "an er th in on re ti st nd ha to it ou ea is".split()
    prose = lambda n: ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(n)]
    data, labels = [], []
    for i in range(400):
        text = prose(rng.randrange(20, 80))
        if i % 4 == 0:
            for insult in rng.sample(["blockhead", "numskull", "dimwit", "scoundrel"], rng.choice([1, 1, 2])):
                text.insert(rng.randrange(len(text)), insult)
        data.append((i, " ".join(text)))
        labels.append((i, int(i % 4 == 0)))
    train_docs = rows("doc_id long, text string, _score string", *[(*d, "clash") for d in data], (900, None, None), (901, "", None))
    label_rows = rows("doc_id long, toxic int", *labels, (900, 0), (0, 0), (5000, 1), (7, None))
    model = toxicity.train(train_docs, label_rows)
    changed = ["block-head", "num.skull", "d i m w i t", "scoundre1", "dimmwit", "blo*ckh*ead", "SCOUNDREL", "numskulls"]
    odd = [(i, " ".join([*prose(20), w, *prose(20)])) for i, w in enumerate(changed)] + [(100 + i, " ".join(prose(60))) for i in range(40)] + [(200, None), (201, ""), (201, "!! 77")]
    got = toxicity.score(rows("doc_id long, text string, row string", *[(*d, "clash") for d in odd]), model)
    assert got.columns == ["doc_id", "text", "row", "_score"]
    found = [(r.doc_id, r._score) for r in got.collect()]
    assert all(0 <= s <= 1 for _, s in found) and len(found) == len(odd)
    assert sum(s >= 0.5 for d, s in found if d < 100) >= 7
    assert sum(s >= 0.5 for d, s in found if d >= 100) <= 1
    none = toxicity.train(train_docs, label_rows.filter("toxic = 0"))
    assert none is None and {r._score for r in toxicity.score(train_docs, None).collect()} == {0.0}
    clean = toxicity.keep_clean(train_docs, model)
    assert clean.columns == train_docs.columns and {r._score for r in clean.collect()} == {"clash", None}


def test_margins_follow_the_kernel():
    """The collapsed weights give what kernel rows times coefficients give."""
    weights, bias = toxicity.train_words(["idiot", "moron"], ["there", "other", "random"])
    raw = np.frombuffer(b"idiot id1ot i.d.i.o.t other", np.uint8)
    value, sizes = toxicity.margins(raw, np.array([0, len(raw)]), weights, bias)
    assert sizes.tolist() == [4] and value[0] == value[1] == value[2] and value[0] > 0 > value[3]
