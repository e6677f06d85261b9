"""Near-duplicate vectors by randomly rotated binary codes.

A vector's code is the signs of its randomly rotated unit form, stored with a correction factor (the
inner product of the unit form and its code). Code and factor give an unbiased estimate of the inner
product with any other vector, whose error is bounded with stated confidence: four standard
deviations here. Pairs whose bound stays below the threshold are settled; all others are computed
again from the full vectors in double precision, so no false link is reported.

1. Equal vectors become one, with a count (combined on the map side).
2. Pivots come from a bounded sample (the first ``PIVOTS`` vectors by hash, thinned so that no two
   lie within the threshold); every vector goes to its nearest pivot.
3. Below a pivot, vectors within half the threshold's angle of a common centre form a ball: all
   its pairs are links by the triangle inequality and are counted, never listed. Crowded pivots are
   worked in blocks whose balls are merged in further rounds.
4. One code for each ball is stored at its pivot and meets the balls that have this pivot among their
   ``PROBES`` nearest; radii widen the bound. Surviving pairs of balls are settled by their centres
   where radii allow, else member by member, in blocks of the larger ball.

Only step 4 can miss a link: when neither ball has the other's pivot among its nearest. The share
found is measured against brute force in the tests (above 0.99 at cosines from 0.9 on).

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with
nothing; a shorter vector counts as padded with zeros; repeated ids are rows of their own; a row
without an id counts as a link of others, and its component is the smallest id reachable, null if
there is none; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .components import connected_components
from .joins import join_hot

LEAST = 0.9
PIVOTS = 4096
PROBES = 12
#: Vectors of one ball-making block, codes held by one comparing block.
BALL_BLOCK, CODE_BLOCK = 512, 8192
DEVIATIONS = 4.0
#: Radians by which a bound must hold before it settles a pair without its vectors.
SLACK = 1e-6


def group_near_vectors(
    vectors: DataFrame, id: str = "vec_id", vec: str = "embedding", least: float = LEAST, block: int = BALL_BLOCK, held: int = CODE_BLOCK
) -> DataFrame:
    """``id``, ``n_links`` (rows at ``least`` or more), ``component_id`` and ``kept`` for every row."""
    rows = vectors.select(F.col(id).alias("_id"), F.col(vec).cast("array<double>").alias("_v"))
    bad = F.exists("_v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists("_v", lambda x: x != 0)
    rows = rows.select("_id", F.when(~F.coalesce(bad, F.lit(True)), F.col("_v")).alias("_v"))
    whole = rows.filter("_v is not null").groupBy("_v").agg(F.min("_id").alias("first"), F.count("*").alias("w"))
    whole = materialise(whole.select(F.monotonically_increasing_id().alias("rep"), "_v", "first", "w"), "vectors")
    n, dim = whole.agg(F.count("*"), F.max(F.size("_v"))).first()
    if not n:
        return _named(rows, id, F.lit(0).cast("long"), F.col("_id"))
    angle = math.acos(least)
    pivots = _pivots(whole, n, dim, angle)
    homes = whole.mapInArrow(_place(pivots, dim), "rep long, home int, vec array<double>, w long")
    homes = materialise(homes, "vector-homes")
    member, balls = _balls(homes, angle / 2, block)
    pairs = _candidates(balls, pivots, dim, angle, held)
    extra, own, edges = _settle(pairs, balls, member, homes, angle, least, block)
    return _label(rows, id, whole, member, balls, extra, own, edges, n)


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as a matrix, short rows padded with zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim))
    out[np.arange(dim)[None, :] < sizes[:, None]] = flat
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).ravel()))


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def _pivots(whole: DataFrame, n: int, dim: int, angle: float) -> np.ndarray:
    """At most ``PIVOTS`` unit vectors, no two within ``angle``; their number grows with the root of the rows."""
    wanted = min(PIVOTS, 2 * math.isqrt(n) + 1)
    drawn = whole.select("_v").orderBy(F.xxhash64("_v"), "_v").limit(wanted).toArrow()
    x = _unit(_matrix(drawn.column(0), dim))
    chosen = np.zeros(len(x), bool)
    bound = math.cos(angle)
    for at in range(len(x)):
        chosen[at] = not chosen[:at].any() or (x[:at][chosen[:at]] @ x[at]).max() < bound
    return x[chosen]


def _place(pivots: np.ndarray, dim: int):
    """Unit vectors at their nearest pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unit(_matrix(batch.column("_v"), dim)) if batch.num_rows else np.zeros((0, dim))
            home = (x @ pivots.T).argmax(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(home), _lists(x), batch.column("w")], ["rep", "home", "vec", "w"])

    return run


def gather(x: np.ndarray, radius: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows into balls of radius ``most`` at most: the ball of each row, centres, radii.

    A row brings its own radius along. A ball starts around the first free row; its centre moves to
    the mean of the rows found, when that keeps the first row.
    """
    ball = np.full(len(x), -1)
    centres, radii = [], []
    near = _angles(x @ x.T) + radius[None, :] <= most
    alone = near.sum(axis=1) - near.diagonal() == 0
    for at in range(len(x)):
        if ball[at] >= 0:
            continue
        free = ball < 0
        inside = near[at] & free
        centre, reach = x[at], radius[at]
        inside[at] = True
        if not alone[at] and inside.sum() > 1:
            mean = x[inside].sum(axis=0)
            mean /= np.linalg.norm(mean)
            far = _angles(x @ mean) + radius
            again = (far <= most) & free
            if again[at] and again.sum() >= inside.sum():
                inside, centre, reach = again, mean, far[again].max()
            else:
                reach = (_angles(x[inside] @ x[at]) + radius[inside]).max()
        ball[inside] = len(centres)
        centres.append(centre)
        radii.append(reach)
    return ball, np.array(centres), np.array(radii)


def _balls(homes: DataFrame, most: float, block: int) -> tuple[DataFrame, DataFrame]:
    """``rep, ball`` and ``ball, home, vec, radius, w, n``; crowded homes go in blocks, whose balls are merged."""

    def make(table: pa.Table) -> pa.Table:
        table = table.sort_by("item")
        item = table.column("item").to_numpy()
        x = _matrix(table.column("vec"), len(table.column("vec")[0]))
        ball, centres, radii = gather(x, table.column("radius").to_numpy(), most)
        first = np.unique(ball, return_index=True)[1]
        lead = np.zeros(len(item), bool)
        lead[first] = True
        order = ball[first]
        vec = np.zeros_like(x)
        vec[first] = centres[order]
        reach = np.zeros(len(item))
        reach[first] = radii[order]
        sums = {c: np.bincount(ball, table.column(c).to_numpy(), len(centres)) for c in ("w", "n")}
        got = {c: np.where(lead, s[ball], 0).astype(np.int64) for c, s in sums.items()}
        names = ["item", "ball", "lead", "home", "vec", "radius", "w", "n"]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lead * x.shape[1])]).astype(np.int32)), pa.array(vec[lead].ravel()))
        return pa.Table.from_arrays([pa.array(item), pa.array(item[first][ball]), pa.array(lead), table.column("home"), lists, pa.array(reach), pa.array(got["w"]), pa.array(got["n"])], names=names)

    shape = "item long, ball long, lead boolean, home int, vec array<double>, radius double, w long, n long"
    items = homes.select(F.col("rep").alias("item"), "home", "vec", F.lit(0.0).alias("radius"), "w", F.lit(1).cast("long").alias("n"))
    member, done, before = None, None, None
    while True:
        # One row for each home: at most PIVOTS.
        crowd = items.groupBy("home").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")).persist()
        split, total = crowd.agg(F.coalesce(F.max("parts"), F.lit(1)), F.coalesce(F.sum("parts"), F.lit(0))).first()
        dealt = items.join(F.broadcast(crowd), "home").withColumn("part", F.pmod(F.xxhash64("item"), F.col("parts")).cast("int"))
        made = materialise(dealt.groupBy("home", "part").applyInArrow(make, shape), "vector-balls")
        crowd.unpersist()
        step = made.select("item", "ball")
        heads = made.filter("lead").drop("item", "lead")
        if member is None:
            member = step.withColumnRenamed("item", "rep")
        else:
            member = member.join(step.select(F.col("item").alias("ball"), F.col("ball").alias("_to")), "ball", "left")
            member = materialise(member.select("rep", F.coalesce("_to", "ball").alias("ball")), "vector-members")
        if split <= 1 or before == total:
            return member, heads if done is None else materialise(done.unionByName(heads), "vector-balls")
        # Only balls of several members are worth merging across blocks.
        before = total
        lone = heads.filter("n = 1")
        done = lone if done is None else done.unionByName(lone)
        items = heads.filter("n > 1").withColumnRenamed("ball", "item")


@lru_cache(maxsize=4)
def _rotation(size: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(77).standard_normal((size, size)))
    return (q * np.sign(np.diag(r))).T


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sign codes (packed), correction factors, and rotated vectors as bytes with their scale."""
    size = max(64, -(-x.shape[1] // 8) * 8)
    turned = x @ _rotation(size)[: x.shape[1]]
    factor = np.abs(turned).sum(axis=1) / math.sqrt(size)
    scale = np.abs(turned).max(axis=1) / 127
    return np.packbits(turned > 0, axis=1), factor, np.rint(turned / scale[:, None]).astype(np.int8), scale


def estimate(code: np.ndarray, factor: np.ndarray, q: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Unbiased inner products of queries (rows) with coded vectors (columns)."""
    signs = np.unpackbits(code, axis=1).astype(np.float32) * 2 - 1
    size = signs.shape[1]
    return (q.astype(np.float32) @ signs.T) * (scale[:, None] / (math.sqrt(size) * factor[None, :]))


def error_bound(factor: np.ndarray, scale: np.ndarray, sine: np.ndarray, size: int) -> np.ndarray:
    """``DEVIATIONS`` standard deviations of the estimate at angles of at most this sine, with those of the byte form."""
    spread = np.sqrt(np.maximum(1 / factor**2 - 1, 0) / (size - 1))[None, :] * sine
    return DEVIATIONS * (spread + scale[:, None] / (math.sqrt(12) * factor[None, :]))


def _runs(batches: Iterator[pa.RecordBatch], held: str) -> Iterator[tuple[pa.Table, pa.Table]]:
    """Sorted by (a, part, kind): the held rows (kind 0) of a key with each stretch of rows that meet them."""
    key, stock = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("a", "part", "kind")]
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        for first, last in zip([0, *new], [*new, batch.num_rows], strict=True):
            here = (cols[0][first], cols[1][first])
            piece = batch.slice(first, last - first)
            if here != key:
                key, stock = here, []
            if cols[2][first] == 0:
                stock.append(piece)
            elif stock:
                if len(stock) > 1:
                    stock = [pa.Table.from_batches(stock).combine_chunks().to_batches()[0]]
                yield pa.Table.from_batches(stock), pa.Table.from_batches([piece])


def _binary(column: pa.ChunkedArray, kind) -> np.ndarray:
    whole = column.combine_chunks()
    _, offsets, data = whole.buffers()
    bounds = np.frombuffer(offsets, np.int32, len(whole) + 1, whole.offset * 4)
    return np.frombuffer(data, kind)[bounds[0] : bounds[-1]].reshape(len(whole), -1)


def _candidates(balls: DataFrame, pivots: np.ndarray, dim: int, angle: float, held: int) -> DataFrame:
    """Pairs of balls ``x < y`` that the codes cannot keep apart."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("vec"), dim)
            codes, factor, q, scale = encode(x)
            near = np.argpartition(-(x @ pivots.T), min(PROBES, len(pivots)) - 1, axis=1)[:, :PROBES].astype(np.int32)
            binary = lambda b: pa.array([r.tobytes() for r in b], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("ball"), batch.column("home"), batch.column("radius"), binary(codes), pa.array(factor), binary(q), pa.array(scale), _lists(near)],
                ["ball", "home", "radius", "code", "factor", "q", "scale", "near"],
            )

    coded = balls.mapInArrow(code, "ball long, home int, radius double, code binary, factor double, q binary, scale double, near array<int>")
    coded = materialise(coded, "vector-codes")
    # One row for each home: at most PIVOTS.
    crowd = F.broadcast(coded.groupBy(F.col("home").alias("a")).agg(F.ceil(F.count("*") / held).cast("int").alias("parts")))
    empty = F.lit(None).cast("binary")
    stored = coded.withColumn("a", F.col("home")).join(crowd, "a").select("a", F.pmod(F.xxhash64("ball"), "parts").cast("int").alias("part"), F.lit(0).alias("kind"), "ball", "radius", "code", "factor", empty.alias("q"), F.lit(0.0).alias("scale"))
    asked = coded.withColumn("a", F.explode(F.array_distinct(F.concat("near", F.array("home"))))).join(crowd, "a")
    asked = asked.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("kind"), "ball", "radius", empty.alias("code"), F.lit(0.0).alias("factor"), "q", "scale")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, queries in _runs(batches, "code"):
            codes, factor = _binary(table.column("code"), np.uint8), table.column("factor").to_numpy()
            mine, wide = table.column("ball").to_numpy(), table.column("radius").to_numpy()
            step = max(1, (1 << 22) // len(mine))
            for at in range(0, queries.num_rows, step):
                part = queries.slice(at, step)
                q, scale, ask = _binary(part.column("q"), np.int8), part.column("scale").to_numpy(), part.column("ball").to_numpy()
                reach = np.minimum(angle + part.column("radius").to_numpy()[:, None] + wide[None, :], math.pi)
                sine = np.where(reach < math.pi / 2, np.sin(reach), 1.0)
                may = estimate(codes, factor, q, scale) + error_bound(factor, scale, sine, codes.shape[1] * 8) >= np.cos(reach)
                i, j = np.nonzero(may)
                x, y = np.minimum(ask[i], mine[j]), np.maximum(ask[i], mine[j])
                other = x != y
                if other.any():
                    yield pa.RecordBatch.from_arrays([pa.array(x[other]), pa.array(y[other])], ["x", "y"])

    rows = stored.unionByName(asked).repartition("a", "part").sortWithinPartitions("a", "part", "kind")
    return materialise(rows.mapInArrow(meet, "x long, y long").distinct(), "vector-pairs")


def _settle(pairs: DataFrame, balls: DataFrame, member: DataFrame, homes: DataFrame, angle: float, least: float, block: int):
    """Links of whole balls (``ball, m``), of single members (``rep, m``), and edges between balls (``a, b``)."""
    side = lambda s: balls.select(F.col("ball").alias(s), F.col("vec").alias(f"v{s}"), F.col("radius").alias(f"r{s}"), F.col("w").alias(f"w{s}"), F.col("n").alias(f"n{s}"))
    both = pairs.join(side("x"), "x").join(side("y"), "y")
    inner = F.aggregate(F.zip_with("vx", "vy", lambda p, q: p * q), F.lit(0.0).cast("double"), lambda s, p: s + p)
    both = both.select("x", "y", "wx", "wy", "nx", "ny", inner.alias("c"), (F.col("rx") + F.col("ry")).alias("r"))
    far = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("c"))))
    lone = (F.col("nx") == 1) & (F.col("ny") == 1)
    state = F.when(lone, F.when(F.col("c") >= least, "all").otherwise("none")).when(far + F.col("r") <= angle - SLACK, "all").when(far - F.col("r") > angle + SLACK, "none").otherwise("some")
    both = materialise(both.withColumn("state", state).filter("state <> 'none'"), "vector-settled")
    sure = both.filter("state = 'all'")
    extra = sure.select(F.col("x").alias("ball"), F.col("wy").alias("m")).unionByName(sure.select(F.col("y").alias("ball"), F.col("wx").alias("m")))
    extra = extra.groupBy("ball").agg(F.sum("m").alias("m"))

    # The larger ball is held in blocks; members of the smaller one pass by.
    swap = F.col("nx") >= F.col("ny")
    open_ = both.filter("state = 'some'").select(F.when(swap, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(swap, F.col("y")).otherwise(F.col("x")).alias("b"), F.ceil(F.greatest("nx", "ny") / block).cast("int").alias("parts"))
    people = member.join(homes.select("rep", "vec", "w"), "rep")
    held = open_.select(F.col("a"), "parts").distinct().join(people.withColumnRenamed("ball", "a"), "a")
    held = held.select("a", F.pmod(F.xxhash64("rep"), "parts").cast("int").alias("part"), F.lit(0).alias("kind"), "rep", "vec", "w", F.col("a").alias("b"))
    passing = open_.join(people.withColumnRenamed("ball", "b"), "b")
    passing = passing.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("kind"), "rep", "vec", "w", "b")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, others in _runs(batches, "vec"):
            dim = len(table.column("vec")[0])
            x, mine, weight = _matrix(table.column("vec"), dim), table.column("rep").to_numpy(), table.column("w").to_numpy()
            a = table.column("a")[0].as_py()
            for at in range(0, others.num_rows, 1024):
                part = others.slice(at, 1024)
                near = _matrix(part.column("vec"), dim) @ x.T >= least
                some = near.any(axis=1)
                if not some.any():
                    continue
                b = np.unique(part.column("b").to_numpy()[some])
                m = np.concatenate([near.T @ part.column("w").to_numpy(), near @ weight])
                rep = np.concatenate([mine, part.column("rep").to_numpy()])
                hit = m > 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([rep[hit], np.full(len(b), -1)])), pa.array(np.concatenate([m[hit], np.zeros(len(b), np.int64)])), pa.array(np.concatenate([np.full(hit.sum(), -1), np.full(len(b), a)])), pa.array(np.concatenate([np.full(hit.sum(), -1), b]))],
                    ["rep", "m", "a", "b"],
                )

    rows = held.unionByName(passing).repartition("a", "part").sortWithinPartitions("a", "part", "kind")
    met = materialise(rows.mapInArrow(meet, "rep long, m long, a long, b long"), "vector-members-met")
    own = met.filter("a < 0").groupBy("rep").agg(F.sum("m").alias("m"))
    edges = sure.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(met.filter("a >= 0").select("a", "b").distinct())
    return extra, own, edges


def _label(rows, id, whole, member, balls, extra, own, edges, n: int) -> DataFrame:
    state = balls.select("ball", "w", "n").join(extra, "ball", "left")
    if edges.isEmpty():
        state = state.withColumn("component", F.col("ball"))
    else:
        state = state.join(connected_components(edges).select(F.col("node").alias("ball"), "component"), "ball", "left")
    state = state.select("ball", "n", (F.col("w") - 1 + F.coalesce("m", F.lit(0))).alias("links"), F.coalesce("component", "ball").alias("component"))
    one = join_hot(member, state, ["ball"], n, "n").join(own, "rep", "left")
    one = one.select("rep", "component", (F.col("links") + F.coalesce("m", F.lit(0))).alias("links"))
    one = materialise(whole.select("rep", "_v", "first", "w").join(one, "rep"), "vector-links")
    lead = one.groupBy("component").agg(F.min("first").alias("lead"), F.count("*").alias("n"))
    total = int(rows.count())
    void = rows.filter("_v is null")
    named = join_hot(one.select("_v", "links", "w", "component"), lead, ["component"], n, "n")
    named = named.select(F.xxhash64("_v").alias("_h"), "_v", "links", "lead", "w")
    out = join_hot(rows.filter("_v is not null").select("_id", F.xxhash64("_v").alias("_h"), "_v"), named, ["_h", "_v"], total, "w")
    return _named(out, id, F.col("links"), F.col("lead")).unionByName(_named(void, id, F.lit(0).cast("long"), F.col("_id")))


def _named(rows: DataFrame, id: str, links: Column, component: Column) -> DataFrame:
    return rows.select(F.col("_id").alias(id), links.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("_id") == component, F.lit(False)).alias("kept"))
