"""Shared plumbing of the corpus operators: scratch tables, row plumbing for Arrow functions, components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract here, as a character class and as plain characters.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session gets a
    folder of its own; a cluster is refused, as its executors could not read each other's folders."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='paperloom-')}")
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/paperloom-scratch/{uuid.uuid4().hex}-{name}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts lineage, survives lost executors, and
    gives the optimizer the table's true size, so that it broadcasts only what is small."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.paperloom_path = path
    return out


def free(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in tables:
        delete_path(df.sparkSession, df.paperloom_path)


#: Bytes of a written table up to which it may be broadcast (in memory it takes several times as many).
BROADCAST_BYTES = 8 << 20


def small(table: DataFrame) -> DataFrame:
    """A staged table, to be broadcast if its files are no larger than BROADCAST_BYTES; else joins shuffle it."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.paperloom_path)
    size = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return F.broadcast(table) if size <= BROADCAST_BYTES else table


#: A key is hot that holds more than one in HOT_SHARE of all rows and more than HOT_ROWS; so at most HOT_SHARE are.
HOT_SHARE, HOT_ROWS = 200, 64
#: Pieces into which the rows of a hot key are dealt.
SALTS = 64


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """The keys (HOT_SHARE of them at most) that hold so many rows that one task should not take them all."""
    return hot_of(rows.groupBy(key).agg(F.count(F.lit(1)).alias("rows")), key, rows.count())


def hot_of(counts: DataFrame, key: str, total: int) -> DataFrame:
    """The same from the rows of each key, counted before."""
    return counts.where(F.col("rows") > max(HOT_ROWS, total / HOT_SHARE)).select(key)


def spread_join(rows: DataFrame, lookup: DataFrame, key: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """Join rows with a lookup that has a key once, such that no task gets all rows of a hot key: these are dealt over
    SALTS salts and the lookup's row of such a key is repeated for each. `hot` holds the hot keys, HOT_SHARE at most,
    which is why it may be broadcast. Rows should be a written table, so that a recomputed task deals them alike."""
    hot = F.broadcast(hot.select(F.col(key).alias("paperloom_hot")))
    is_hot = F.col("paperloom_hot").isNotNull()
    dealt = rows.join(hot, F.col(key) == F.col("paperloom_hot"), "left")
    salt = F.when(is_hot, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(0)
    dealt = dealt.withColumn("paperloom_salt", salt.cast("int")).drop("paperloom_hot")
    repeated = lookup.join(hot, F.col(key) == F.col("paperloom_hot"), "left")
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    repeated = repeated.withColumn("paperloom_salt", F.explode(salts)).drop("paperloom_hot")
    return dealt.join(repeated, [key, "paperloom_salt"], how).drop("paperloom_salt")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b), as (node, root) with root the smallest node of the component.

    Minimum labels spread over links and are then shortened by one pointer jump a round, so rounds grow with the
    logarithm of the diameter. Links with a null end are ignored, empty input gives no rows. Labels live in tables of
    the shared folder, replaced each round; nothing but counts comes to the driver. The nodes of a large component all
    point at few labels: the jump deals such labels over many tasks. Nodes with very many links of their own should be
    linked through others (a tree of bounded degree does).
    """
    both = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    both = staged(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")), "labels")
    for _ in range(max_rounds):
        near = (
            both.join(labels.select(F.col("node").alias("b"), "root"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("root").alias("near"))
        )
        hooked = staged(labels.join(near, "node").select("node", "root", F.least("root", "near").alias("low")), "hooked")
        far = labels.select(F.col("node").alias("low"), F.col("root").alias("far"))
        jumped = spread_join(hooked, far, "low", hot_keys(hooked, "low"))
        root = F.least("low", "far")
        fresh = staged(jumped.select("node", root.alias("root"), (root != F.col("root")).alias("moved")), "labels")
        free(labels, hooked)
        labels = fresh
        if not labels.where("moved").limit(1).count():
            free(both)
            return labels.select("node", "root")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
