"""Versions of packages as registries state them, and the mirror that holds them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.text import package_name

#: Metadata beyond this size, or with a document type, is not looked at.
LARGEST_XML = 512 << 10


def versions_of_metadata(xml: Column) -> Column:
    """Versions of a repository's metadata; an empty array for too large or unsafe documents."""
    safe = (F.octet_length(xml) <= LARGEST_XML) & ~F.upper(xml).contains("<!DOCTYPE")
    # xpath is evaluated for sound documents only.
    return F.when(safe, F.xpath(F.when(safe, xml), F.lit("metadata/versioning/versions/version/text()"))).otherwise(F.array().cast("array<string>"))


def versions_of_lines(body: Column) -> Column:
    return F.filter(F.transform(F.split(body, "\n"), lambda v: F.trim(v)), lambda v: v != "")


def versions_of_keys(json: Column, field: str) -> Column:
    """The names below an object, such as {"versions": {"1.0": ...}}."""
    return F.coalesce(F.json_object_keys(F.get_json_object(json, f"$.{field}")), F.array().cast("array<string>"))


def is_module(name: Column) -> Column:
    return name.contains("/") & name.contains(".")


def versions_of(mirror: DataFrame, asked: DataFrame) -> DataFrame:
    """The mirror's rows for (ecosystem, name), names compared as their ecosystem does; nulls in versions are left out."""
    keys = asked.select("ecosystem", "name", package_name(F.col("ecosystem"), F.col("name")).alias("package_name")).distinct()
    return keys.join(mirror, ["ecosystem", "package_name"]).withColumn("versions", F.array_compact("versions"))


def has_entries(mirror: DataFrame, ecosystems: DataFrame) -> DataFrame:
    """Ecosystems (ecosystem, enabled) that are enabled, and whether the mirror has any of their packages."""
    there = mirror.select("ecosystem").distinct().withColumn("there", F.lit(True))
    return ecosystems.where("enabled").join(there, "ecosystem", "left").select("ecosystem", F.coalesce("there", F.lit(False)).alias("has_entries"))


def names_to_refresh(seeds: DataFrame, identified: DataFrame, mirror: DataFrame, fresh_since: Column) -> DataFrame:
    """(ecosystem, package_name) of seed and identified names together, without those the mirror has refreshed since."""
    named = lambda df: df.select("ecosystem", package_name(F.col("ecosystem"), F.col("package_name")).alias("package_name")).where("package_name is not null")
    fresh = mirror.where(F.col("last_synced_at") >= fresh_since).select("ecosystem", "package_name")
    return named(seeds).union(named(identified)).distinct().join(fresh, ["ecosystem", "package_name"], "left_anti")
