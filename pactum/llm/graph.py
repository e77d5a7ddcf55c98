"""Links inside groups of candidates and connected components by alternating star contractions, on DataFrames only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """The smallest node reachable from each node that has an edge.

    edges: columns u, v of one orderable type; direction, order and repeats don't matter, self loops and
    rows with a null end are ignored. Returns (node, root), without rows for nodes whose only edges are
    self loops; no edges give an empty table. Each round writes its edges into the shared folder: the work
    of a round is two aggregations and two joins on the nodes, and hubs are split by the join, not collected.
    """
    now = scratch.write(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    state = _state(now)
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.write(large.where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = scratch.write(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        scratch.release(now, large)
        now, was, state = after, state, _state(after)
        if state == was:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select("v").distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select(F.col("v").alias("node"), F.col("v").alias("root"))
    )


def join_components(components: DataFrame | None, links: DataFrame, scratch: Scratch) -> DataFrame | None:
    """components (node, root) and the scratch table of further links (a, b) as one table of components; links is released."""
    if links.isEmpty():
        scratch.release(links)
        return components
    if components is None:
        joined = scratch.write(connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch))
        scratch.release(links)
        return joined
    # Only what the further links join is worked on: edges between components, and nodes in none.
    edges = rooted_by(rooted_by(links, components, "a").withColumnRenamed("root", "u"), components, "b").withColumnRenamed("root", "v")
    moved = scratch.write(connected_components(edges.select("u", "v"), scratch))
    found = components.join(moved.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left")
    alone = moved.join(components.select("node"), "node", "left_anti")
    joined = scratch.write(found.select("node", F.coalesce("to", "root").alias("root")).unionByName(alone))
    scratch.release(links, components, moved)
    return joined


def pivot_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of each group's members with its most central one.

    rows: (key, id, size). Central is the member whose groups are largest in sum, ties to the smaller id: of near copies
    of one text that is the text with the fewest changes of its own. Members can be linked only where
    100 * smaller size >= percent * larger.
    """
    counted = rows.join(rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "key")
    weight = counted.groupBy("id").agg(F.sum("c").alias("weight"))
    best = rows.join(weight, "id").groupBy("key").agg(F.max(F.struct("weight", (-F.col("id")).alias("less"), F.col("id").alias("p"), F.col("size").alias("ps"))).alias("m"))
    pairs = rows.join(best.select("key", "m.p", "m.ps"), "key").where("id <> p").where(_sized("size", "ps", percent))
    return pairs.select(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b")).distinct()


def split_groups(rows: DataFrame, components: DataFrame | None, most: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The rows of groups whose members lie in several components: of groups up to `most` members, and of larger ones."""
    rooted = rooted_by(rows, components)
    several = rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count(F.lit(1)).alias("c")).where("x < y").select("key", "c")
    left = scratch.write(rows.join(several, "key"))
    return tuple(left.where(cut).select(*rows.columns) for cut in (f"c <= {most}", f"c > {most}"))


#: A row lists the other groups of its member where those are no more than this.
LISTED = 256


def pairs_in_groups(rows: DataFrame, components: DataFrame | None, percent: int, scratch: Scratch, shared: int = 1) -> DataFrame:
    """Pairs (a, b) of different components that are together in at least `shared` groups.

    Where rows also have `pos`, a key is an item of a set in a common order and pos its place: pairs remain that can reach
    the similarity `percent` if the item is the first they share.
    """
    once = shared == 1 and "pos" not in rows.columns
    if once:
        # The groups of a member that come before each of its own: a pair is made in the first group it shares, and not once in
        # each. Members of very many groups have no list; their pairs come several times, and one of each is left in the end.
        few = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(f"n <= {LISTED}")
        lists = rows.join(few, "id", "left_semi").groupBy("id").agg(F.sort_array(F.collect_set("key")).alias("groups"))
        rows = rows.join(lists, "id", "left")
        rows = rows.select("key", "id", "size", F.expr("slice(groups, 1, cast(array_position(groups, key) as int) - 1)").alias("before"))
    rooted = scratch.write(rooted_by(rows, components))
    # The members of a group's largest component are joined with the others only.
    main = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.max(F.struct("c", "root")).alias("m"))
    outer = rooted.join(main.select("key", F.col("m.root").alias("main")), "key").where("root <> main")
    place = [c for c in ("pos", "before") if c in rows.columns]
    outer = outer.select("key", "main", *[F.col(c).alias(f"{c}_a") for c in ("id", "size", "root", *place)])
    inner = rooted.select("key", *[F.col(c).alias(f"{c}_b") for c in ("id", "size", "root", *place)])
    pairs = outer.join(inner, "key").where("root_a <> root_b and (root_b = main or id_a < id_b)").where(_sized("size_a", "size_b", percent))
    if once:
        pairs = pairs.where("not coalesce(arrays_overlap(before_a, before_b), false)")
    elif "pos" in place:
        pairs = pairs.where(f"least(size_a - pos_a, size_b - pos_b) * {100 + percent}L >= {percent}L * (size_a + size_b)")
    pairs = pairs.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= shared).select("a", "b")


def rooted_by(rows: DataFrame, components: DataFrame | None, side: str = "id") -> DataFrame:
    """rows with the root of each row's id, or the id itself."""
    if components is None:
        return rows.withColumn("root", F.col(side))
    roots = components.select(F.col("node").alias(side), "root")
    return rows.join(roots, side, "left").withColumn("root", F.coalesce("root", side))


def _sized(a: str, b: str, percent: int) -> Column:
    return F.expr(f"100L * least({a}, {b}) >= {percent}L * greatest({a}, {b})")


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))
    ).first()
    return tuple(row)
