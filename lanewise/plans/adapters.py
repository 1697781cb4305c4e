"""Road-shaped projections of the star-schema tables.

The driver's tables hold no roads. Each relation here is one deterministic
projection, written once as expressions that Spark and DuckDB read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The box that the nodes fill.
BOX = {"west": 90.326774, "east": 90.499678, "south": 23.711736, "north": 23.902086}

NODE = (
    "c_custkey AS node_id",
    "90.326774E0 + CAST((c_custkey * 7919) % 10000 AS DOUBLE) / 10000E0 * 0.172904E0 AS lon",
    "23.711736E0 + CAST((c_custkey * 6133) % 10000 AS DOUBLE) / 10000E0 * 0.19035E0 AS lat",
)
EDGE = (
    "o_orderkey AS edge_id",
    "o_custkey AS u",
    "(o_custkey * 31 + o_orderkey * 17 + 1) % {n} AS v",
    "CAST(20 + CAST(floor(o_totalprice) AS BIGINT) % 131 AS DOUBLE) AS length_m",
    "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'primary' WHEN '2' THEN 'secondary' WHEN '3' THEN 'tertiary' "
    "WHEN '4' THEN 'residential' ELSE 'living_street' END AS highway",
)
ROAD = (
    "edge_id", "u", "v", "length_m", "highway",
    "CASE highway WHEN 'primary' THEN 2400E0 WHEN 'secondary' THEN 2000E0 WHEN 'tertiary' THEN 1600E0 WHEN 'residential' THEN 500E0 ELSE 300E0 END AS capacity_vph",
    "CASE highway WHEN 'primary' THEN 50E0 WHEN 'secondary' THEN 40E0 WHEN 'tertiary' THEN 35E0 WHEN 'residential' THEN 25E0 ELSE 15E0 END AS free_flow_kmph",
    "CASE highway WHEN 'primary' THEN 2 WHEN 'secondary' THEN 3 WHEN 'tertiary' THEN 4 WHEN 'residential' THEN 6 ELSE 7 END AS class_rank",
    "edge_id % 3 = 0 AS oneway",
)
PIXEL = (
    "(l_orderkey * 37 + l_partkey * 11) % 256 AS r",
    "(l_partkey * 53 + l_suppkey * 7) % 256 AS g",
    "(l_orderkey * 5 + l_suppkey * 91) % 256 AS b",
    "(l_orderkey + l_linenumber) % 256 AS a",
)
WEIGHTS = ("DISTINCT CAST(20 + o_orderkey % 91 AS DOUBLE) AS weight",)

SQL = {
    "nodes": f"SELECT {', '.join(NODE)} FROM customer",
    "edges": (
        "SELECT " + ", ".join(ROAD) + ", length_m / (free_flow_kmph / 3.6E0) AS free_flow_s FROM (SELECT "
        + ", ".join(ROAD) + " FROM (SELECT " + ", ".join(EDGE).format(n="(SELECT count(*) FROM customer)") + " FROM orders) WHERE u <> v)"
    ),
    "readings": (
        "SELECT user_id AS edge_id, date_trunc('hour', ts) AS ts, CAST(max(CAST(floor(value) AS BIGINT) % 4) AS INTEGER) AS level, "
        "CAST(max(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) AS INTEGER) AS painted FROM events GROUP BY 1, 2"
    ),
    "pixels": f"SELECT {', '.join(PIXEL)} FROM lineitem",
    "weights": f"SELECT {WEIGHTS[0]} FROM orders",
}
SQL["today"] = "SELECT edge_id, arg_max(level, ts) AS level FROM readings GROUP BY edge_id"


def with_sql(query: str, *names: str) -> str:
    """``query`` with the named relations in front, each with what it needs."""
    order = [n for n in SQL if n in names or (n == "readings" and "today" in names)]
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({SQL[n]})" for n in order) + " " + query.strip()


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "customer").selectExpr(*NODE)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _read(spark, sf_dir, "customer").count()  # read from the footers
    raw = _read(spark, sf_dir, "orders").selectExpr(*[e.format(n=n) for e in EDGE]).where("u <> v")
    return raw.selectExpr(*ROAD).withColumn("free_flow_s", F.expr("length_m / (free_flow_kmph / 3.6E0)"))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _read(spark, sf_dir, "events")
        .groupBy(F.col("user_id").alias("edge_id"), F.date_trunc("hour", "ts").alias("ts"))
        .agg(
            F.max(F.expr("CAST(floor(value) AS BIGINT) % 4")).cast("int").alias("level"),
            F.max(F.when(F.col("event_type") != "error", 1).otherwise(0)).alias("painted"),
        )
    )


def today(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readings(spark, sf_dir).groupBy("edge_id").agg(F.max_by("level", "ts").alias("level"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").selectExpr(*PIXEL)


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").selectExpr(WEIGHTS[0].removeprefix("DISTINCT ")).distinct()
