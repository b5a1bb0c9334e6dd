"""Building blocks of iterative plans: lineage cuts that survive executor loss, and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    The cluster names it in ``spark.checkpoint.dir``. Only where nothing is set and the master is local (tests) a
    temporary folder of this machine is taken: executors of a cluster would not see it.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = f"file://{tempfile.mkdtemp(prefix='odweave-checkpoint-')}"
    sc.setCheckpointDir(folder)
    return folder


def shared_table(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and read it back, which cuts the lineage.

    Unlike a cached or locally checkpointed frame, the table survives the loss of any executor. It is removed
    when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/odweave/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return spark.read.schema(df.schema).parquet(path)


def drop_shared(*tables: DataFrame) -> None:
    """Delete the files of tables made by :func:`shared_table` that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour at most, and none of those has a smaller one itself."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up")).union(edges.select("v", F.lit(0)))
    per = ends.groupBy("x").agg(F.sum("up").alias("up"), F.count(F.lit(1)).alias("n"))
    return per.where("up > 1 OR (up = 1 AND n > 1)").count() == 0


#: Up to so many nodes (16 bytes each) the smallest neighbours are broadcast; beyond, the joins shuffle.
BROADCAST_ROWS = 400_000


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge list: ``(node, component)``, component = smallest node.

    Alternating large-star and small-star rounds, until all edges point from a node to its component: every round is
    two aggregations, which fold a hub's edges before the shuffle, and two joins of the edge list with one row a node.
    These rows are broadcast up to a checked number; beyond, both sides are read from tables, so that AQE splits a hub.
    No component is gathered in one task either way. Nodes without any edge are not listed; self edges list their node; edges with a NULL
    end are ignored.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    nodes = pairs.where("u = v").select(F.col("u").alias("node"))
    current = shared_table(
        pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    # Rounds never add edges, so the first count bounds the nodes of all.
    small = 2 * current.count() <= BROADCAST_ROWS

    def node_rows(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small else shared_table(df, "low")

    def edge_rows(df: DataFrame) -> DataFrame:
        return df if small else shared_table(df, "edges")

    for _ in range(max_rounds):
        if _settled(current):
            break
        both = current.union(current.select("v", "u"))
        low = node_rows(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(low, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = edge_rows(large)
        # In the small star every node has only smaller neighbours left: u > v holds in ``large``.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        low = node_rows(least)
        star = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least)
        nxt = shared_table(star.distinct(), "edges")
        drop_shared(current)
        current = nxt
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    heads = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    lone = nodes.distinct().join(found.select("node").union(heads.select("node")), "node", "left_anti")
    return found.union(heads).union(lone.select("node", F.col("node").alias("component")))
