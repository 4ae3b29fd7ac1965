"""What other registers say about the entities: population, a listed flag, a category of lists, all joined to the ids.

rows(id, code, region, name): the entities; names are compared normalised, within their region.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldt.functions.scalars import code8, normal_name
from veldt.operators.relational import carry_header

#: Words that say what kind of unit a name is, not which.
KINDS = ("region", "nation", "district")


def name_key(region: Column, name: Column) -> Column:
    return F.concat_ws("|", normal_name(region, KINDS), normal_name(name, KINDS))


def population(rows: DataFrame, bulletin: DataFrame) -> DataFrame:
    """(id, pop, urban, urban_share): field by field by code, else by region and name. bulletin(code, region, name, pop, urban); of repeated keys the least code."""
    found = bulletin.select(F.substring(F.regexp_replace("code", " ", ""), 1, 8).alias("_code"), name_key(F.col("region"), F.col("name")).alias("_key"), "code", "pop", "urban")
    out = rows.select("id", F.col("code").alias("_code"), name_key(F.col("region"), F.col("name")).alias("_key"))
    for by, n in (("_code", "a"), ("_key", "b")):
        one = found.groupBy(by).agg(F.min_by(F.struct("pop", "urban"), "code").alias(n))
        out = out.join(one, by, "left")
    out = out.select("id", *[F.coalesce(F.col("a")[c], F.col("b")[c]).alias(c) for c in ("pop", "urban")])
    return out.select("*", F.try_divide("urban", "pop").alias("urban_share"))


def listed(rows: DataFrame, sheet: DataFrame, is_header: Column) -> DataFrame:
    """(id, listed): is the entity in a sheet(line, text) whose region headers stand before their members?"""
    members = carry_header(sheet, is_header, F.col("text"), "line").select(name_key(F.col("header"), F.col("text")).alias("_key")).distinct()
    keyed = rows.select("id", name_key(F.col("region"), F.col("name")).alias("_key"))
    return keyed.join(members.withColumn("listed", F.lit(True)), "_key", "left").select("id", F.coalesce("listed", F.lit(False)).alias("listed"))


def category(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """(id, status): of lists(place, code, status) the first that names the entity's code; null in none."""
    first = lists.groupBy(code8(F.col("code")).alias("_code")).agg(F.min_by("status", F.struct("place", "status")).alias("status"))
    return rows.select("id", F.col("code").alias("_code")).join(first, "_code", "left").select("id", "status")


def bundle(ids: DataFrame, *parts: DataFrame) -> DataFrame:
    """ids(id) with the columns of every part(id, ...), nulls where a part has no row."""
    out = ids.select("id")
    for p in parts:
        out = out.join(p, "id", "left")
    return out


def latest(rows: DataFrame, version: str) -> DataFrame:
    """The row of each id with the greatest version, then code."""
    w = Window.partitionBy("id").orderBy(F.desc(version), F.desc("code"))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
