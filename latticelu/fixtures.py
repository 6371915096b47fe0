"""Matrices and right-hand sides made of the driver tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.matrix import SparseMatrix

REGIONS, NATIONS = 5, 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hierarchy_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b): nation to region and supplier to nation; ids 0.., 5 + nation, 30 + supplier."""
    nations = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + REGIONS).cast("bigint").alias("a"), F.col("n_regionkey").cast("bigint").alias("b"))
    suppliers = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + REGIONS + NATIONS).cast("bigint").alias("a"), (F.col("s_nationkey") + REGIONS).cast("bigint").alias("b"))
    return nations.union(suppliers)


def laplacian(edges: DataFrame, n: int) -> SparseMatrix:
    """-1 for each edge, both ways; the diagonal is degree plus 1."""
    off = edges.select(F.col("a").alias("i"), F.col("b").alias("j")).union(edges.select("b", "a"))
    degree = off.groupBy("i").agg(F.count("*").alias("d"))
    diagonal = edges.sparkSession.range(n).select(F.col("id").alias("i")).join(degree, "i", "left").select("i", F.col("i").alias("j"), (F.coalesce("d", F.lit(0)) + 1.0).alias("v"))
    return SparseMatrix(off.select("i", "j", F.lit(-1.0).alias("v")).unionByName(diagonal), n)


def hierarchy(spark: SparkSession, sf_dir: str) -> SparseMatrix:
    """Root-first: heavy fill."""
    n = REGIONS + NATIONS + table(spark, sf_dir, "supplier").count()
    return laplacian(hierarchy_edges(spark, sf_dir), n)


def co_supply(spark: SparkSession, sf_dir: str) -> SparseMatrix:
    """Suppliers that share an order among the large returned items."""
    rows = table(spark, sf_dir, "lineitem").filter("l_quantity >= 45 and l_returnflag = 'R'").select("l_orderkey", F.col("l_suppkey").cast("bigint").alias("s")).distinct()
    left, right = rows.withColumnRenamed("s", "a"), rows.withColumnRenamed("s", "b")
    pairs = left.join(right, "l_orderkey").filter("a < b").select("a", "b").distinct()
    return laplacian(pairs, table(spark, sf_dir, "supplier").count())


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, j, v): how often an event of user j follows one of user i, i <> j."""
    # events are numbered, so the next event is a join by number, not one window over all rows
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("bigint").alias("u"))
    after = e.select((F.col("event_id") - 1).alias("event_id"), F.col("u").alias("w"))
    return e.join(after, "event_id").filter("u <> w").groupBy(F.col("u").alias("i"), F.col("w").alias("j")).agg(F.count("*").cast("double").alias("v"))


def transition_matrix(spark: SparkSession, sf_dir: str) -> SparseMatrix:
    """Unsymmetric and dominant: the diagonal is row sum plus column sum plus 1."""
    off = transitions(spark, sf_dir)
    sums = off.select("i", "v").union(off.select("j", "v")).groupBy("i").agg(F.sum("v").alias("s"))
    n = table(spark, sf_dir, "events").agg(F.max("user_id")).first()[0] + 1
    diagonal = spark.range(n).select(F.col("id").alias("i")).join(sums, "i", "left").select("i", F.col("i").alias("j"), (F.coalesce("s", F.lit(0.0)) + 1.0).alias("v"))
    return SparseMatrix(off.unionByName(diagonal), n)


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, j, v): part by supplier, summed quantities; rectangular."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy(F.col("l_partkey").cast("bigint").alias("i"), F.col("l_suppkey").cast("bigint").alias("j")).agg(F.sum(F.col("l_quantity").cast("double")).alias("v"))


def account_rhs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, v): suppliers' balances on their ids of the hierarchy."""
    return table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + REGIONS + NATIONS).cast("bigint").alias("i"), F.col("s_acctbal").cast("double").alias("v"))


# ---------------------------------------------------------------- the same in SQL

HIERARCHY_N = "(SELECT 30 + count(*) FROM supplier)"
HIERARCHY_SQL = """
edges AS (SELECT 5 + n_nationkey::BIGINT AS a, n_regionkey::BIGINT AS b FROM nation
          UNION ALL SELECT 30 + s_suppkey::BIGINT, 5 + s_nationkey::BIGINT FROM supplier),
off AS (SELECT a AS i, b AS j FROM edges UNION ALL SELECT b, a FROM edges),
m AS (SELECT i, j, -1.0::DOUBLE AS v FROM off
      UNION ALL SELECT r.i, r.i, (count(o.i) + 1)::DOUBLE FROM range((SELECT 30 + count(*) FROM supplier)) AS r(i) LEFT JOIN off o ON o.i = r.i GROUP BY r.i)"""
CO_SUPPLY_SQL = """
items AS (SELECT DISTINCT l_orderkey AS o, l_suppkey::BIGINT AS s FROM lineitem WHERE l_quantity >= 45 AND l_returnflag = 'R'),
edges AS (SELECT DISTINCT x.s AS a, y.s AS b FROM items x JOIN items y ON x.o = y.o AND x.s < y.s),
off AS (SELECT a AS i, b AS j FROM edges UNION ALL SELECT b, a FROM edges),
m AS (SELECT i, j, -1.0::DOUBLE AS v FROM off
      UNION ALL SELECT r.i, r.i, (count(o.i) + 1)::DOUBLE FROM range((SELECT count(*) FROM supplier)) AS r(i) LEFT JOIN off o ON o.i = r.i GROUP BY r.i)"""
TRANSITIONS_SQL = """
steps AS (SELECT user_id::BIGINT AS i, (lead(user_id) OVER (ORDER BY event_id))::BIGINT AS j FROM events),
t AS (SELECT i, j, count(*)::DOUBLE AS v FROM steps WHERE j IS NOT NULL AND i <> j GROUP BY i, j)"""
TRANSITION_MATRIX_SQL = (
    TRANSITIONS_SQL
    + """,
sums AS (SELECT i, sum(v) AS s FROM (SELECT i, v FROM t UNION ALL SELECT j, v FROM t) GROUP BY i),
m AS (SELECT i, j, v FROM t
      UNION ALL SELECT r.i, r.i, coalesce(s.s, 0) + 1 FROM range((SELECT max(user_id) + 1 FROM events)) AS r(i) LEFT JOIN sums s ON s.i = r.i)"""
)
RATINGS_SQL = "m AS (SELECT l_partkey::BIGINT AS i, l_suppkey::BIGINT AS j, sum(l_quantity::DOUBLE) AS v FROM lineitem GROUP BY 1, 2)"
