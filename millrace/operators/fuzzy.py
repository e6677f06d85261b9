"""Near-duplicate names: exact candidate search by a segment index, then connected groups.

A name cut into k + 1 segments keeps one of them through k edits, at most k places away. So every name
of more than k characters is listed by its length, segment number and segment, and looks up the
segments that a longer or equally long name could share with it. Names of at most k characters all
lie within k edits of each other; they are linked to the smallest one instead of pair by pair. The
search runs over distinct names: copies are counted once, however many there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import need, need_columns
from ..session import cut_lineage
from .windows import dedupe


def _names(df: DataFrame, name: str, exact: Sequence[str], same_soundex: bool) -> tuple[DataFrame, list[str]]:
    need_columns(df, [name, *exact])
    names = df.select(*exact, F.lower(F.trim(name)).alias("__name")).distinct().filter("__name IS NOT NULL")
    keys = list(exact)
    if same_soundex:
        names = names.withColumn("__sound", F.soundex("__name"))
        keys.append("__sound")
    return names.withColumn("__size", F.length("__name")), keys


def _segment(size: Column, k: int) -> Column:
    """Number, start (from 0) and size of the k + 1 segments of a text of ``size`` characters."""
    cut = lambda i: F.floor(size * i / (k + 1)).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(k)), lambda i: F.struct(i.alias("i"), cut(i).alias("at"), (cut(i + 1) - cut(i)).alias("n")))


def _indexed_pairs(names: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """Pairs within ``k`` edits of which the longer name has more than ``k`` characters."""
    listed = names.filter(F.col("__size") > k).select(*keys, F.col("__name").alias("__long"), F.col("__size").alias("__l"), F.explode(_segment(F.col("__size"), k)).alias("s"))
    listed = listed.select(*keys, "__long", "__l", F.col("s.i").alias("__i"), F.expr("substring(__long, s.at + 1, s.n)").alias("__seg"))
    asked = names.select(*keys, F.col("__name").alias("__short"), F.col("__size").alias("__m"), F.explode(F.expr(f"sequence(greatest(__size, {k} + 1), greatest(__size, {k} + 1) + {k})")).alias("__l"))
    asked = asked.filter(F.col("__l") <= F.col("__m") + k)
    asked = asked.select("*", F.explode(_segment(F.col("__l"), k)).alias("s"))
    asked = asked.select("*", F.explode(F.expr(f"sequence(greatest(s.at - {k}, 0), s.at + {k})")).alias("__at")).filter(F.col("__at") + F.col("s.n") <= F.col("__m"))
    asked = asked.select(*keys, "__short", "__m", "__l", F.col("s.i").alias("__i"), F.expr("substring(__short, __at + 1, s.n)").alias("__seg")).distinct()
    met = asked.join(listed, [*keys, "__l", "__i", "__seg"]).filter((F.col("__m") < F.col("__l")) | (F.col("__short") < F.col("__long")))
    met = met.select(*keys, F.least("__short", "__long").alias("left_name"), F.greatest("__short", "__long").alias("right_name")).distinct()
    return met.filter(F.levenshtein("left_name", "right_name") <= k)


def similar_pairs(
    df: DataFrame, name: str, *, exact: Sequence[str] = (), max_edits: int = 1, same_soundex: bool = True
) -> DataFrame:
    """Distinct name pairs ``left_name < right_name`` within ``max_edits`` that agree on all other keys.

    Names of at most ``max_edits`` characters are all similar, so their pairs are as many as asked for;
    ``dedupe_fuzzy`` does without them.
    """
    need(max_edits > 0, "INVALID_MAX_EDITS", str(max_edits))
    names, keys = _names(df, name, exact, same_soundex)
    tiny = names.filter(F.col("__size") <= max_edits).select(*keys, F.col("__name").alias("left_name"))
    close = tiny.join(tiny.withColumnRenamed("left_name", "right_name"), keys) if keys else tiny.crossJoin(tiny.withColumnRenamed("left_name", "right_name"))
    pairs = _indexed_pairs(names, keys, max_edits).unionByName(close.filter("left_name < right_name"))
    return pairs.select(*exact, "left_name", "right_name").distinct()


def _similar_links(df: DataFrame, name: str, exact: Sequence[str], max_edits: int, same_soundex: bool) -> DataFrame:
    """Links that connect what ``similar_pairs`` does: names too short for segments hang on the smallest of them."""
    need(max_edits > 0, "INVALID_MAX_EDITS", str(max_edits))
    names, keys = _names(df, name, exact, same_soundex)
    tiny = names.filter(F.col("__size") <= max_edits)
    if keys:
        lead = tiny.groupBy(*keys).agg(F.min("__name").alias("left_name"))
        star = tiny.join(lead, keys)
    else:
        star = tiny.withColumn("left_name", tiny.agg(F.min("__name").alias("x")).scalar())
    star = star.filter("left_name < __name").select(*exact, "left_name", F.col("__name").alias("right_name"))
    return _indexed_pairs(names, keys, max_edits).select(*exact, "left_name", "right_name").unionByName(star).distinct()


def connected_groups(pairs: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Smallest reachable name per name: columns ``scope, name, group_name``.

    Large and small stars take turns: links are rewritten until all of a group point at its smallest
    name. Minima combine on the map side; the rounds needed grow with the logarithm of a chain's length.
    """
    scope = list(scope)
    named = pairs.select(*scope, F.greatest("left_name", "right_name").alias("a"), F.least("left_name", "right_name").alias("b"))
    links = cut_lineage(named.filter("a <> b").distinct())
    seen = None
    while True:
        both = links.unionByName(links.select(*scope, F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(*scope, "a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, [*scope, "a"]).select(*scope, F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy(*scope, "a").agg(F.min("b").alias("m"))
        moved = large.join(least, [*scope, "a"]).filter("b <> m").select(*scope, F.col("b").alias("a"), F.col("m").alias("b"))
        links = cut_lineage(moved.unionByName(least.select(*scope, "a", F.col("m").alias("b"))).distinct())
        state = links.agg(F.count("*"), F.bit_xor(F.xxhash64(*scope, "a", "b"))).first()
        if state == seen:
            break
        seen = state
    roots = links.select(*scope, F.col("b").alias("name")).distinct().withColumn("group_name", F.col("name"))
    return links.select(*scope, F.col("a").alias("name"), F.col("b").alias("group_name")).unionByName(roots)


def dedupe_fuzzy(
    df: DataFrame,
    name: str,
    *,
    exact: Sequence[str] = (),
    order: Sequence[str] = (),
    max_edits: int = 1,
    same_soundex: bool = True,
    group: str = "group_name",
) -> DataFrame:
    """One row per group of similar names; names without a near match are their own group.

    Rows without a name resemble nothing: all of them stay, with a null group.
    """
    nameless = df.filter(F.col(name).isNull()).withColumn(group, F.lit(None).cast("string"))
    df = df.filter(F.col(name).isNotNull())
    groups = connected_groups(_similar_links(df, name, exact, max_edits, same_soundex), exact)
    own = F.lower(F.trim(F.col(name)))
    side = groups.withColumnsRenamed({"name": "__name", "group_name": "__group"})
    tagged = (
        df.withColumn("__name", own)
        .join(side, [*exact, "__name"], "left")
        .withColumn(group, F.coalesce("__group", "__name"))
        .select(*df.columns, group)
    )
    return dedupe(tagged, [*exact, group], order).unionByName(nameless)
