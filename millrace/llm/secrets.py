"""Secret scan with a trigram index.

From each rule's expression follows a Boolean query over trigrams that any match must contain. For
every block of texts the scan builds an inverted index, trigram to posting list, of the trigrams
that some rule asks for; each rule's query intersects and unites postings, and only the texts that
remain are searched with the expression. Rules without a mandatory trigram search every text.

Blocks are Arrow batches of a partition: the index of a block never leaves its task, so nothing is
shuffled or collected, and a lost executor costs only its own blocks.

Defined cases: a null text is empty; matches are leftmost and do not overlap within a rule, and
those that fail a rule's length are dropped afterwards; spans are code points, end exclusive, by
start and then by rule order; extra columns are ignored; repeated ids are separate texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytesio import groups_of_rows, text_bytes


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    at_least: int = 0
    base: bool = True


# The base kinds, in order, then the kinds this operator adds. Runs of hex digits match
# greedily, so asking for sixteen in the expression drops the same runs as a check afterwards.
RULES = (
    Rule("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"(?a)AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"(?a)[0-9a-f]{16,}", 0, 16),
    Rule("pem", r"(?a)-----BEGIN [A-Z ]*PRIVATE KEY-----", base=False),
    Rule("github", r"(?a)gh[pousr]_[A-Za-z0-9]{36,}", base=False),
    Rule("slack", r"(?a)xox[abprs]-[A-Za-z0-9-]{10,}", base=False),
    Rule("jwt", r"(?a)eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", base=False),
)

#: All clauses must hold; a clause holds when all trigrams of one of its alternatives are present.
Query = tuple[tuple[frozenset[str], ...], ...]

MOST_STRINGS = 64
BLOCK_BYTES = 4 << 20


def trigram_query(pattern: str) -> Query:
    """What every match must contain, in lower case; no clauses where nothing is certain."""
    clauses, run = [], {""}
    for part in [*_parts(_parser.parse(pattern)), None]:
        if part is not None and len(run) * len(part) <= MOST_STRINGS:
            run = {a + b for a in run for b in part}
            continue
        if all(len(x) >= 3 for x in run):
            clauses.append(tuple(sorted((frozenset(x[i : i + 3] for i in range(len(x) - 2)) for x in run), key=sorted)))
        run = {""} if part is None else set(part)
    return tuple(clauses)


def _parts(items) -> list[set[str] | None]:
    """The expression as a sequence of string sets; None stands where anything may stand."""
    out: list[set[str] | None] = []
    for op, arg in items:
        if op is C.LITERAL and arg < 128:
            out.append({chr(arg).lower()})
        elif op is C.IN and len(arg) <= 8 and all(o is C.LITERAL and a < 128 for o, a in arg):
            out.append({chr(a).lower() for _, a in arg})
        elif op is C.SUBPATTERN:
            out.extend(_parts(arg[3]))
        elif op is C.BRANCH:
            choices = [_product(_parts(b)) for b in arg[1]]
            out.append(None if None in choices else set().union(*choices))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            inner = _product(_parts(arg[2]))
            if inner is None or arg[1] > 1:
                out.append(None)
                if inner is not None and arg[0] > 0:
                    out += [inner] * min(arg[0], 8) + [None]
            else:
                out.append(inner | {""} if arg[0] == 0 else inner)
        else:
            out.append(None)
    return out


def _product(parts: list[set[str] | None]) -> set[str] | None:
    done = {""}
    for p in parts:
        if p is None or len(done) * len(p) > MOST_STRINGS:
            return None
        done = {a + b for a in done for b in p}
    return done


def build_postings(raw: np.ndarray, bounds: np.ndarray, slots: np.ndarray, wanted: list[str]) -> dict[str, np.ndarray]:
    """Trigram to the sorted rows that contain it, for the wanted trigrams (``slots``: code to place + 1)."""
    found: list[list[np.ndarray]] = [[] for _ in wanted]
    for first, last in groups_of_rows(bounds, BLOCK_BYTES):
        part = raw[bounds[first] : bounds[last]]
        if len(part) < 3:
            continue
        low = (part + ((part >= 65) & (part <= 90)) * np.uint8(32)).astype(np.uint32)
        slot = slots[low[:-2] | (low[1:-1] << np.uint32(8)) | (low[2:] << np.uint32(16))]
        at = np.flatnonzero(slot)
        row = np.searchsorted(bounds, at + bounds[first], side="right") - 1
        inside = at + bounds[first] + 2 < bounds[row + 1]
        pairs = np.unique(slot[at[inside]].astype(np.int64) * len(bounds) + row[inside])
        which, rows = pairs // len(bounds) - 1, pairs % len(bounds)
        cuts = np.searchsorted(which, np.arange(len(wanted) + 1))
        for k in range(len(wanted)):
            found[k].append(rows[cuts[k] : cuts[k + 1]])
    none = np.zeros(0, np.int64)
    return {t: np.concatenate(f) if f else none for t, f in zip(wanted, found, strict=True)}


def candidates(query: Query, postings: dict[str, np.ndarray]) -> np.ndarray:
    """Rows that satisfy the query, from the postings alone."""
    rows = None
    for clause in query:
        hit = np.zeros(0, np.int64)
        for trigrams in clause:
            both = None
            for t in sorted(trigrams, key=lambda t: len(postings[t])):
                both = postings[t] if both is None else np.intersect1d(both, postings[t], assume_unique=True)
            hit = np.union1d(hit, both)
        rows = hit if rows is None else np.intersect1d(rows, hit, assume_unique=True)
    return rows


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and ``found``, an array of (kind, start, end, base)."""
    queries = [trigram_query(r.pattern) for r in rules]
    wanted = sorted({t for q in queries for c in q for alternative in c for t in alternative})
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())])
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("found", T.ArrayType(span))])
    arrow_span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [re.compile(r.pattern) for r in rules]
        slots = np.zeros(1 << 24, np.uint8 if len(wanted) < 255 else np.uint32)
        for k, t in enumerate(wanted):
            slots[ord(t[0]) | ord(t[1]) << 8 | ord(t[2]) << 16] = k + 1
        for batch in batches:
            texts = batch.column("text")
            raw, bounds = text_bytes(texts)
            postings = build_postings(raw, bounds, slots, wanted)
            todo = [candidates(q, postings) if q else np.arange(len(texts)) for q in queries]
            rules_of: list[list[int]] = [[] for _ in range(len(texts))]
            for k, rows in enumerate(todo):
                for row in rows.tolist():
                    rules_of[row].append(k)
            out = []
            for row, own in enumerate(rules_of):
                text = texts[row].as_py() if own else ""
                hits = [(m.start(), k, m.end()) for k in own for m in compiled[k].finditer(text) if len(m.group(rules[k].group)) >= rules[k].at_least]
                out.append([{"kind": rules[k].kind, "start": a, "end": b, "base": rules[k].base} for a, k, b in sorted(hits)])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.list_(arrow_span))], ["id", "found"])

    return base.mapInArrow(run, schema).withColumnRenamed("id", id_col)
