"""Cumulative bucket sets over nested advice documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Buckets of the probability of an interrupt; the first label is spelled with the letter O.
LABELS = ("O-5%", "5-10%", "10-15%", "15-20%", ">20%")
ANY = -1
_TYPES = "map<string,struct<r:int,s:int>>"
SCHEMA = (
    "ranges array<struct<label:string,index:int,dots:int,max:int>>, "
    "instance_types map<string,struct<cores:int,emr:boolean,ram_gb:double>>, "
    f"spot_advisor map<string,struct<Windows:{_TYPES},Linux:{_TYPES}>>"
)


def label(bucket: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, LABELS)), bucket + 1)


def max_probability(bucket: Column) -> Column:
    return bucket


def read_advice(spark: SparkSession, path: str) -> DataFrame:
    """region, os, instance, bucket (r), savings (s): one row per entry of the nested document."""
    doc = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    per_region = doc.select(F.explode("spot_advisor").alias("region", "x"))
    both = F.array(F.struct(F.lit("Windows").alias("os"), F.col("x.Windows").alias("m")), F.struct(F.lit("Linux").alias("os"), F.col("x.Linux").alias("m")))
    per_os = per_region.select("region", F.explode(both).alias("o")).select("region", "o.os", F.explode("o.m").alias("instance", "v"))
    return per_os.select("region", "os", "instance", F.col("v.r").alias("bucket"), F.col("v.s").alias("savings"))


def cumulative_sets(advice: DataFrame, keys: list[str], instance: str = "instance", bucket: str = "bucket", buckets: int = len(LABELS)) -> DataFrame:
    """keys, bucket, instances: for each bucket all instances of it and of lower ones, sorted; empty buckets have rows too."""
    each = advice.groupBy(*keys, instance).agg(F.min(bucket).alias("least"))
    upto = each.select(*keys, instance, F.explode(F.sequence(F.col("least"), F.lit(buckets - 1))).alias("bucket"))
    sets = upto.groupBy(*keys, "bucket").agg(F.array_sort(F.collect_set(instance)).alias("instances"))
    every = advice.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    return every.join(sets, [*keys, "bucket"], "left").withColumn("instances", F.coalesce("instances", F.array().cast("array<string>")))


def filter_candidates(candidates: DataFrame, advice: DataFrame, where: Column, bucket: int, instance: str = "instance") -> DataFrame:
    """Candidates whose instance has advice (``where``: os and region) of at most ``bucket``; with ANY all of them."""
    if bucket == ANY:
        return candidates
    allowed = advice.where(where & (F.col("bucket") <= bucket)).select(instance).distinct()
    return candidates.join(allowed, instance, "left_semi")


def lookup(advice: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (region, os, instance) with bucket, or the level that is missing in ``problem``."""
    regions = advice.select("region").distinct().withColumn("_r", F.lit(True))
    systems = advice.select("region", "os").distinct().withColumn("_o", F.lit(True))
    found = wanted.join(regions, "region", "left").join(systems, ["region", "os"], "left").join(advice.select("region", "os", "instance", "bucket"), ["region", "os", "instance"], "left")
    problem = F.when(F.col("_r").isNull(), "no such region").when(F.col("_o").isNull(), "no such os").when(F.col("bucket").isNull(), "no such instance")
    return found.withColumn("problem", problem).drop("_r", "_o")
