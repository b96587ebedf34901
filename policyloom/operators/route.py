"""Which reference frameworks a dimension and a country are evaluated against."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from policyloom import lexicons as lx
from policyloom.functions import text as tx
from policyloom.operators.ordering import first_per_key


def normalize_country(country: Column) -> Column:
    return F.replace(F.lower(F.trim(F.coalesce(country, F.lit("")))), F.lit("_"), F.lit(" "))


def region_table(spark: SparkSession, regions: dict | None = None) -> DataFrame:
    regions = lx.REGION_COUNTRIES if regions is None else regions
    rows = [(region, country) for region, names in regions.items() for country in names]
    return spark.createDataFrame(rows, "region string, country_key string")


def regions_of(countries: DataFrame, regions: DataFrame, country: str = "country") -> DataFrame:
    """Left side keeps every country; region is null where none applies."""
    keyed = countries.withColumn("country_key", normalize_country(F.col(country)))
    return keyed.join(regions, "country_key", "left").drop("country_key")


def dimension_frameworks(catalog: DataFrame, roles: Sequence[str] | None = None) -> DataFrame:
    """``(dimension, name, ord)`` of the tagged frameworks, optionally by role."""
    chosen = catalog.filter(tx.has_role(F.col("roles"), roles)) if roles else catalog
    return chosen.select(F.explode("dimensions").alias("dimension"), "name", "ord")


def regional_frameworks(catalog: DataFrame) -> DataFrame:
    tagged = catalog.select(F.explode("regions").alias("region"), "name", "ord")
    return tagged.filter(F.col("region") != "Global")


def regional_subset(countries: DataFrame, catalog: DataFrame, regions: DataFrame, roles: Sequence[str] | None = None) -> DataFrame:
    """The regional frameworks of each country, optionally by role; countries of no region have none."""
    chosen = catalog.filter(tx.has_role(F.col("roles"), roles)) if roles else catalog
    return regions_of(countries, regions).join(regional_frameworks(chosen), "region")


def route(
    requests: DataFrame, catalog: DataFrame, regions: DataFrame, core: Sequence[str] = lx.CORE_FRAMEWORKS,
) -> DataFrame:
    """Ordered framework list per request ``(request keys, dimension, country)``.

    Tiers in order: core, dimension-tagged normative, regional; first mention wins.
    """
    keys = requests.columns
    core_rows = F.explode(
        F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(n).alias("name")) for i, n in enumerate(core)])
    )
    always = requests.select(*keys, F.lit(0).alias("tier"), core_rows.alias("_c")).select(
        *keys, "tier", F.col("_c.ord").cast("long").alias("ord"), F.col("_c.name").alias("name")
    )
    tagged = requests.join(dimension_frameworks(catalog, [lx.NORMATIVE]), "dimension").select(
        *keys, F.lit(1).alias("tier"), F.col("ord").cast("long").alias("ord"), "name"
    )
    regional = (
        regions_of(requests, regions)
        .join(regional_frameworks(catalog), "region")
        .select(*keys, F.lit(2).alias("tier"), F.col("ord").cast("long").alias("ord"), "name")
    )
    return first_per_key(always.unionByName(tagged).unionByName(regional), [*keys, "name"], ["tier", "ord"])
