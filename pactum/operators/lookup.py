"""Keyed lookup: a left join with at most one match, the first by the source's order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.catalog import ORDER


def first_by_key(source: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """One row per key: k0, k1, ... and the returned record `r`. Null keys match nothing."""
    rec = F.struct(*[F.col(f"`{f}`").alias(f) for f in fields])
    named = source.select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)], F.col(ORDER), rec.alias("r"))
    named = named.where(" and ".join(f"k{i} is not null" for i in range(len(keys))))
    grouped = named.groupBy(*[f"k{i}" for i in range(len(keys))])
    return grouped.agg(F.min_by("r", ORDER).alias("r"))


def join_lookup(df: DataFrame, values: list[Column], source: DataFrame, keys: list[str], fields: list[str], name: str) -> DataFrame:
    """df with a nullable struct column `name`. Spark broadcasts the source where its size allows it, else both sides are shuffled."""
    temp = [f"{name}:k{i}" for i in range(len(values))]
    right = first_by_key(source, keys, fields)
    right = right.select(*[F.col(f"k{i}").alias(f"{name}:r{i}") for i in range(len(keys))], F.col("r").alias(name))
    left = df.withColumns(dict(zip(temp, values, strict=True)))
    on = [F.col(f"`{t}`") == F.col(f"`{name}:r{i}`") for i, t in enumerate(temp)]
    return left.join(right, on, "left").drop(*temp, *[f"{name}:r{i}" for i in range(len(keys))])


def join_elements(df: DataFrame, lists: list[Column], source: DataFrame, keys: list[str], fields: list[str], name: str) -> DataFrame:
    """df with an array column `name` of the records looked up for each place of the key lists (all of one length).

    What is found depends on the key lists alone: each distinct one is looked up once and joined back by its value, so no
    row needs a number, which a retried task could give anew.
    """
    asked = f"{name}:keys"
    first, n = lists[0], range(len(lists))
    zipped = F.transform(first, lambda x, i: F.struct(*[F.get(lists[k], i).alias(f"z{k}") for k in n]))
    left = df.withColumn(asked, zipped)
    each = left.select(F.col(f"`{asked}`").alias("keys")).where("keys is not null").distinct()
    places = each.select("keys", F.posexplode("keys").alias("p", "z"))
    found = join_lookup(places, [F.col("z").getField(f"z{i}") for i in n], source, keys, fields, "hit")
    packed = found.groupBy("keys").agg(F.array_sort(F.collect_list(F.struct("p", "hit"))).alias("a"))
    packed = packed.select("keys", F.transform("a", lambda s: s["hit"]).alias(name))
    return left.join(packed, F.col(f"`{asked}`") == F.col("keys"), "left").drop("keys", asked)
