"""Chat formatting after cumulative-snapshot collapse.

Logs often hold a conversation many times, once for each turn that was added. A rolling hash over
the turns names every prefix of a conversation; a conversation whose full hash is a proper prefix of
some longer one is dropped by an anti-join, and of equal conversations the smallest id stays. The
rest is rendered.

Texts travel once. Turns are first reduced to two 64-bit hashes for each conversation, number and role,
and the collapse works on those alone. A plain conversation has an id, at most ``SLICE`` rows and one
text for each number and role: its places follow from numbers and roles, and only the conversations
that stay fetch their texts, shuffled by conversation for both the join and the rendering.

All others are placed with their texts. Their distinct turns are range-partitioned by conversation,
turn, role and the first ``LEAD`` characters of the text; the turns of a conversation in one range are
a slice. Slices are shares of the rows, whatever the turn numbers are: a conversation of any length, one
that repeats or lacks turn numbers and the rows without a conversation are spread over tasks. Only turns
that agree in all of these keys stay together. Turns are numbered inside slices and the hash of a slice
is carried on. The prefix hash is the running exclusive-or of two 64-bit hashes of (place, role, text):
equal sequences give equal hashes, and slices combine freely. A rendered conversation is one row for each
``SLICE`` turns, by place.

Defined cases: turns are ordered by turn number (null last), then role and text; a row repeated in
full counts once; a null text is empty and a null role is ``unknown``; rows without a conversation
id form one conversation; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sizes import broadcast_if_small
from ..session import materialise

SLICE = 1024
LEAD = 256


def _earlier():
    return W.partitionBy("_conv").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)


def _same() -> list:
    return [F.col("l._conv").eqNullSafe(F.col("r._conv")), F.col("l._slice") == F.col("r._slice")]


def _own(turns: DataFrame) -> DataFrame:
    return turns.select(
        F.col("conv_id").alias("_conv"), F.col("turn").cast("long").alias("_turn"),
        F.coalesce("role", F.lit("unknown")).alias("_role"), F.coalesce("text", F.lit("")).alias("_text"),
    )


def _hashes() -> dict:
    return {"_a": F.xxhash64("_role", "_text"), "_b": F.xxhash64(F.lit(7), "_text", "_role")}


def _digests(turns: DataFrame) -> DataFrame:
    """One row for each conversation, number and role: rows, the hashes of one text, and whether there are several."""
    t = _own(turns).withColumns(_hashes()).groupBy("_conv", "_turn", "_role")
    t = t.agg(F.count("*").alias("_n"), F.min("_a").alias("_a"), F.min("_b").alias("_b"), F.max("_a").alias("_a1"), F.max("_b").alias("_b1"))
    return t.withColumn("_tied", (F.col("_a") != F.col("_a1")) | (F.col("_b") != F.col("_b1"))).drop("_a1", "_b1")


def _placed(turns: DataFrame) -> DataFrame:
    """Distinct turns with their slice, place in the conversation (from 1), its number of turns, and two hashes."""
    t = _own(turns).distinct()
    t = t.repartitionByRange(F.col("_conv"), F.col("_turn").asc_nulls_last(), F.col("_role"), F.substring("_text", 1, LEAD))
    t = materialise(t.withColumn("_slice", F.spark_partition_id()), "turns")  # the ranges must stay as they are
    t = t.withColumns(_hashes())
    inside = W.partitionBy("_conv", "_slice").orderBy(F.col("_turn").asc_nulls_last(), "_role", "_text")
    t = t.withColumn("_place", F.row_number().over(inside).cast("long"))
    sizes = t.groupBy("_conv", "_slice").agg(F.count("*").alias("_n"))
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(_earlier()), F.lit(0)))
    sizes = sizes.withColumn("_total", F.sum("_n").over(W.partitionBy("_conv")))
    at = (F.col("_before") + F.col("_place")).alias("_at")
    return t.alias("l").join(sizes.alias("r"), _same()).select("l._conv", "l._slice", "_role", "_text", "_a", "_b", at, "_total")


def _mixed() -> dict:
    return {"_x": F.xxhash64("_at", "_a", "_b"), "_y": F.xxhash64("_b", "_at", F.lit(3), "_a")}


def _plain_prefixes(digests: DataFrame, plain: DataFrame) -> DataFrame:
    """Hashes of all prefixes of plain conversations: number and role give the places."""
    t = digests.join(plain, "_conv").select("_conv", "_turn", "_role", "_a", "_b")
    inside = W.partitionBy("_conv").orderBy(F.col("_turn").asc_nulls_last(), "_role")
    t = t.withColumn("_at", F.row_number().over(inside).cast("long")).withColumn("_total", F.count("*").over(W.partitionBy("_conv")))
    running = W.partitionBy("_conv").orderBy("_at").rowsBetween(W.unboundedPreceding, 0)
    t = t.withColumns(_mixed()).withColumns({"_px": F.bit_xor("_x").over(running), "_py": F.bit_xor("_y").over(running)})
    return t.select("_conv", "_at", "_total", "_px", "_py", F.lit(True).alias("_plain"))


def _sliced_prefixes(placed: DataFrame) -> DataFrame:
    """Hashes of all prefixes of conversations in slices: the hash of the slices before is carried on."""
    t = placed.withColumns(_mixed()).select("_conv", "_slice", "_at", "_total", "_x", "_y")
    state = t.groupBy("_conv", "_slice").agg(F.bit_xor("_x").alias("_sx"), F.bit_xor("_y").alias("_sy"))
    state = state.withColumn("_cx", F.coalesce(F.bit_xor("_sx").over(_earlier()), F.lit(0)))
    state = state.withColumn("_cy", F.coalesce(F.bit_xor("_sy").over(_earlier()), F.lit(0))).drop("_sx", "_sy")
    running = W.partitionBy("_conv", "_slice").orderBy("_at").rowsBetween(W.unboundedPreceding, 0)
    t = t.withColumn("_rx", F.bit_xor("_x").over(running)).withColumn("_ry", F.bit_xor("_y").over(running))
    px, py = F.col("_rx").bitwiseXOR(F.col("_cx")).alias("_px"), F.col("_ry").bitwiseXOR(F.col("_cy")).alias("_py")
    return t.alias("l").join(state.alias("r"), _same()).select("l._conv", "_at", "_total", px, py, F.lit(False).alias("_plain"))


def collapse_snapshots(prefixes: DataFrame) -> DataFrame:
    """Conversations that no longer one extends: ``conv_id``, ``n_turns``, ``n_copies``, and whether it is plain."""
    keys = ["_total", "_px", "_py"]
    full = prefixes.filter("_at = _total").groupBy(*keys)
    # The conversation without an id counts as the smallest only where it is alone.
    full = full.agg(F.min("_conv").alias("conv_id"), F.count("*").alias("n_copies"), F.min_by("_plain", "_conv").alias("_plain"))
    inner = prefixes.filter("_at < _total").select(F.col("_at").alias("_total"), "_px", "_py").distinct()
    kept = full.join(inner, keys, "left_anti")
    return kept.select("conv_id", F.col("_total").alias("n_turns"), "n_copies", F.coalesce("_plain", F.lit(False)).alias("_plain"))


def _piece():
    return F.concat(F.lit("<|im_start|>"), F.col("_role"), F.lit("\n"), F.col("_text"), F.lit("<|im_end|>\n"))


def render_plain(turns: DataFrame, kept: DataFrame) -> DataFrame:
    """Plain conversations as text: at most ``SLICE`` rows of each meet, in one part."""
    t = _own(turns).join(kept.select(F.col("conv_id").alias("_conv"), "n_turns", "n_copies"), "_conv")
    turn = F.struct(F.col("_turn").isNull().alias("none"), "_turn", "_role", _piece().alias("piece"))
    t = t.groupBy("_conv").agg(F.max("n_turns").alias("n_turns"), F.max("n_copies").alias("n_copies"), F.array_sort(F.collect_set(turn)).alias("all"))
    rendered = F.array_join(F.transform("all", lambda x: x["piece"]), "").alias("rendered")
    return t.select(F.col("_conv").alias("conv_id"), F.lit(0).cast("long").alias("part"), "n_turns", "n_copies", rendered)


def render(placed: DataFrame, kept: DataFrame) -> DataFrame:
    """The kept conversations as text: ``conv_id``, ``part`` (``SLICE`` turns each, from 0), ``n_turns``, ``n_copies``, ``rendered``."""
    t = placed.select("_conv", F.floor((F.col("_at") - 1) / SLICE).alias("part"), F.struct("_at", _piece().alias("_piece")).alias("_piece"))
    parts = t.groupBy("_conv", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list("_piece")), lambda p: p["_piece"]), "").alias("rendered"))
    return parts.join(kept, parts["_conv"].eqNullSafe(kept["conv_id"])).select("conv_id", "part", "n_turns", "n_copies", "rendered")


def format_conversations(turns: DataFrame) -> DataFrame:
    """Collapse snapshots, then render what stays."""
    digests = materialise(_digests(turns), "digests")
    plain = F.col("_conv").isNotNull() & (F.col("_rows") <= SLICE) & ~F.col("_tied")
    known = digests.groupBy("_conv").agg(F.sum("_n").alias("_rows"), F.max("_tied").alias("_tied")).select("_conv", plain.alias("_plain"))
    others = broadcast_if_small(known.filter("NOT _plain").select("_conv"))
    placed = _placed(turns.join(others, turns["conv_id"].eqNullSafe(others["_conv"]), "left_semi"))
    kept = collapse_snapshots(_plain_prefixes(digests, known.filter("_plain").select("_conv")).unionByName(_sliced_prefixes(placed)))
    kept = materialise(kept, "kept")
    return render_plain(turns, kept.filter("_plain")).unionByName(render(placed, kept.filter("NOT _plain").drop("_plain")))
