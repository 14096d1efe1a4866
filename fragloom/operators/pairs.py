"""Pairs of fragments: enumeration, names, and matching the two sides of a scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def all_pairs(fragments: DataFrame, within: str, key: str = "frag_id", blocks: int = 8) -> DataFrame:
    """(within, a, b): every unordered pair of fragments of one group, a < b.

    Groups may be few and large (the sides of all scans), so each is cut into ``blocks`` by a hash of the fragment: the pairs of two blocks are a join key of
    their own, and a group is dealt out to blocks^2 tasks. Each fragment is sent ``blocks`` times.
    """
    own, other = F.pmod(F.xxhash64(key), F.lit(blocks)), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    one = fragments.select(within, F.col(key).alias("a"), own.alias("block_a"), other.alias("block_b"))
    two = fragments.select(within, F.col(key).alias("b"), own.alias("block_b"), other.alias("block_a"))
    return one.join(two, [within, "block_a", "block_b"]).where("a < b").select(within, "a", "b")


def pending(pairs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs without a result yet. ``keys`` should hold the parameters of the run as well, so that other parameters are not taken for done."""
    return pairs.join(done, keys, "left_anti")


def stem(path: Column) -> Column:
    """File name without folder and ending."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def side_of(path: Column) -> Column:
    return F.when(F.lower(stem(path)).contains("_back"), "verso").otherwise("recto")


def pair_name(a: Column, b: Column) -> Column:
    return F.concat_ws("__", a, b)


def parsed(names: DataFrame, column: str = "name") -> DataFrame:
    """The names that are two parts joined by a double underscore, with the parts a and b."""
    parts = F.split(F.regexp_replace(column, r"\.hdf5$", ""), "__")
    return names.where(F.size(parts) == 2).withColumns({"a": parts[0], "b": parts[1]})


def match_sides(recto: DataFrame, verso: DataFrame, strict: bool = False) -> DataFrame:
    """(a, b, verso_a, verso_b): the verso pair of each recto pair.

    By default the verso names must start with the recto names, and the smallest pair of names wins; this may pick 10_back for 1. The verso names are cut
    to the lengths that recto names have (a few numbers), so this is an equi-join too. ``strict`` asks for the exact name with ``_back``.
    """
    v = verso.select(F.col("a").alias("verso_a"), F.col("b").alias("verso_b"))
    if strict:
        bare = lambda c: F.regexp_replace(c, "_back$", "")
        return recto.join(v.withColumns({"a": bare("verso_a"), "b": bare("verso_b")}), ["a", "b"]).select("a", "b", "verso_a", "verso_b")
    lengths = recto.select(F.explode(F.array(F.length("a"), F.length("b"))).alias("n")).distinct().agg(F.sort_array(F.collect_list("n"))).first()[0]
    for c in "ab":
        cuts = [F.when(F.length(f"verso_{c}") >= n, F.substring(f"verso_{c}", 1, n)) for n in lengths]
        v = v.withColumn(c, F.explode(F.array_distinct(F.array_compact(F.array(F.lit(None).cast("string"), *cuts)))))
    found = recto.select("a", "b").join(v, ["a", "b"])
    order = Window.partitionBy("a", "b").orderBy("verso_a", "verso_b")
    return found.withColumn("rn", F.row_number().over(order)).where("rn = 1").select("a", "b", "verso_a", "verso_b")
