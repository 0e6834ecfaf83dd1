"""Shared helpers of the corpus operators: shared work folders, tables that cut lineage, gapless numbering, components."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: The word of every contract here: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ship(spark: SparkSession) -> None:
    """Let Python workers started by this session import the package from a checkout (a cluster ships it by --py-files)."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, _ROOT])


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder below spark.checkpoint.dir; a temporary one only where that setting is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="llm-work-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there and any executor can reread it."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores until no column of df has it (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame, by: list[str], spread: list[str], order: list[str], out: str, label: str) -> DataFrame:
    """df with a gapless long number from 0 within ``by``, none of whose groups is sorted in one task.

    Rows of a group are dealt by a hash of ``spread`` to about sqrt(rows) buckets; buckets get
    offsets by a running sum over the small bucket table, rows a number within their bucket.
    Equal rows get numbers in any order; everything else is fixed by the data.
    """
    names = [f"_by{i}" for i in range(len(by))]
    total = df.groupBy(*by).agg(F.ceil(F.sqrt(F.count(F.lit(1)))).cast("long").alias("_b")).toDF(*names, "_b")
    match = lambda t: [F.col(c).eqNullSafe(F.col(n)) for c, n in zip(by, names, strict=True)]
    rows = df.join(total, on=match(total), how="inner").select(*df.columns, F.pmod(F.xxhash64(*spread), F.col("_b")).alias("_k"))
    rows = cut(rows, label)
    before = W.partitionBy(*by).orderBy("_k").rowsBetween(W.unboundedPreceding, -1)
    sizes = rows.groupBy(*by, "_k").agg(F.count(F.lit(1)).alias("_n")).withColumn("_at", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    sizes = sizes.select(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)], F.col("_k").alias("_bk"), "_at")
    inside = F.row_number().over(W.partitionBy(*by, "_k").orderBy(*order)) - 1
    ranked = rows.withColumn("_in", inside).join(sizes, on=[*match(sizes), F.col("_k") == F.col("_bk")], how="inner")
    return ranked.select(*df.columns, (F.col("_in") + F.col("_at")).cast("long").alias(out))


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, root): the smallest node reachable by ``edges`` (a long, b long); isolated nodes are left out.

    Edges point from the larger to the smaller end. A round keeps each node's smallest
    parent, links its other parents to that one, and then jumps to the parent's parent.
    The jump is a left join, so AQE can split the rows of a parent that has very many
    children; the loop ends when no node has two parents and no parent has one.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("c"), F.least("a", "b").alias("p"))
    e = cut(e.distinct(), label)
    while True:
        # a join and not a window, so that AQE can split the rows of a node that has very many parents
        least = e.groupBy("c").agg(F.min("p").alias("m")).withColumnRenamed("c", "q")
        one = e.join(least, e.c == least.q).select(F.explode(F.expr("if(p = m, array(named_struct('c', c, 'p', m, 'more', 0L)), array(named_struct('c', p, 'p', m, 'more', 1L)))")).alias("x")).select("x.*")
        one = cut(one, label)
        up = one.groupBy("c").agg(F.min("p").alias("up")).withColumnRenamed("c", "q")
        jumped = one.join(up, one.p == up.q, "left").select("c", F.coalesce("up", "p").alias("p"), F.greatest(F.col("more"), F.col("up").isNotNull().cast("long")).alias("more"))
        e = cut(jumped.groupBy("c", "p").agg(F.max("more").alias("more")), label)
        if not e.agg(F.max("more").alias("x")).first().x:
            return e.select(F.col("c").alias("node"), F.col("p").alias("root"))
        e = e.select("c", "p")
