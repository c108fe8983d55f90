"""Driver tables seen as images, cubes, composites, stacks and catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def img(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One image: a vector a row, a component a column."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("y"), F.posexplode("embedding").alias("x", "v"))
    return rows.select("y", F.col("x").cast("long").alias("x"), F.col("v").cast("double").alias("v"))


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cube 0: a label a plane, its vectors the rows."""
    row = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    rows = table(spark, sf_dir, "embeddings").select(F.lit(0).alias("cube"), F.col("label").alias("z"), row.cast("long").alias("y"), "embedding")
    return rows.select("cube", "z", "y", F.posexplode("embedding").alias("x", "v")).withColumns({"x": F.col("x").cast("long"), "v": F.col("v").cast("double")})


def rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A composite in 0 to 1, with all that names a line."""
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    return table(spark, sf_dir, "lineitem").select(*keys, (F.col("l_quantity") / 50).alias("r"), (F.col("l_discount") * 10).alias("g"), (F.col("l_tax") * 10).alias("b"))


def stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("pixel"), F.col("l_quantity").alias("v"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("frame"), F.col("user_id").alias("pixel"), F.col("event_id").alias("id"), F.col("value").alias("v"))


def stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("star_id"), (k * 7919 % 1000).cast("double").alias("x"), (k * 104729 % 997).cast("double").alias("y"), F.col("c_acctbal").alias("flux"))


def sky(spark: SparkSession, sf_dir: str, name: str, key: str, id_name: str, a: int, b: int) -> DataFrame:
    k = F.col(key)
    return table(spark, sf_dir, name).select(k.alias(id_name), ((k * a % 36000) / 100).cast("double").alias("ra"), ((k * b % 17000) / 100 - 85).cast("double").alias("dec"))


# The same views for the SQL that queries are held against.
SQL = {
    "img": "img AS (SELECT vec_id AS y, i - 1 AS x, CAST(embedding[i] AS DOUBLE) AS v FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))",
    "cube": "cube AS (SELECT label AS z, y, i - 1 AS x, CAST(embedding[i] AS DOUBLE) AS v FROM (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS y, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))",
    "rgb": "rgb AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity / 50 AS r, l_discount * 10 AS g, l_tax * 10 AS b FROM lineitem)",
    "stack": "stack AS (SELECT l_partkey AS pixel, l_quantity AS v FROM lineitem)",
    "frames": "frames AS (SELECT event_type AS frame, user_id AS pixel, event_id AS id, value AS v FROM events)",
    "stars": "stars AS (SELECT c_custkey AS star_id, CAST(c_custkey * 7919 % 1000 AS DOUBLE) AS x, CAST(c_custkey * 104729 % 997 AS DOUBLE) AS y, c_acctbal AS flux FROM customer)",
}


def using(*names: str) -> str:
    return "WITH " + ", ".join(SQL[n] for n in names)
