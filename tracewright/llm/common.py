"""What the operators of this package share: scratch tables on shared storage, components, documents."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that is unset on a local master (tests on one machine) a temporary folder is taken and
    kept in the session's configuration; on a cluster executors would not see each other's rows there.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.tracewright.scratch", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.tracewright.scratch", path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tracewright-{uuid.uuid4().hex}/{name}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    It cuts the lineage: a lost executor costs at most the stages since the last written table.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def trim() -> None:
    """Give freed memory back to the system where the C library can: Spark's Python workers outlive their tasks."""
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give:
        give(0)


def release(df: DataFrame) -> None:
    """Delete a table of ``materialise`` that nothing reads any more."""
    path = getattr(df, "_scratch", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph: (node long, component long), component the least node.

    ``edges`` has columns u, v (long); an edge with a null end is none. Alternating large-star and small-star rounds (Kiveris et al.,
    2014): each round is two grouped minima and joins, the edge list never grows by more than one
    edge a node, and the number of rounds is logarithmic. The edges of each round are written to the
    shared folder; the driver only sees a count of changed edges. Nodes without edges don't appear.
    A hub's neighbours are never gathered in one group: minima are pre-aggregated, and joins on hubs
    are left to the adaptive skew split.
    """
    u, v = F.col("u"), F.col("v")
    cur = edges.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()
    cur = materialise(cur, "edges")
    for _ in range(max_rounds):
        both = cur.select("u", "v").unionByName(cur.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(v > u).join(least, "u").select(v.alias("u"), F.col("m").alias("v"))
        down = large.where(u != v).distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(v.alias("u"), F.col("m").alias("v")).where(u != v)
        new = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        new = materialise(new, "edges")
        changed = new.join(cur, ["u", "v"], "left_anti").limit(1).count() or cur.join(new, ["u", "v"], "left_anti").limit(1).count()
        release(cur)
        cur = new
        if not changed:
            break
    else:
        raise RuntimeError("components did not settle")
    return cur.select(u.alias("node"), v.alias("component")).unionByName(
        cur.select(v.alias("node"), v.alias("component")).distinct()
    )
