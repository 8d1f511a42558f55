"""What the operators share: shared-folder tables, reading, block sizes, and joins on keys that many rows have."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import spread, table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table; a small one in few splits is dealt to all cores."""
    return spread(table(spark, sf_dir, "documents"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where that is unset, a local master gets a temporary folder, as in tests; on a cluster, whose machines don't share
    one, this raises.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    kept = getattr(sc, "_canopy_dir", None)
    if kept is None:
        kept = sc._canopy_dir = tempfile.mkdtemp(prefix="canopy-")
    return kept


def stored(df: DataFrame) -> DataFrame:
    """df, computed once into a table in the shared folder: later reads neither recompute it nor need its executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/canopy-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._canopy_path = path
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Deletes tables of stored() that nothing reads any more."""
    for t in tables:
        path = getattr(t, "_canopy_path", None)
        if path:
            jvm = t.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def swept(spark: SparkSession) -> None:
    """Collects the driver's garbage: broadcast tables and shuffle files of finished queries go only then, here and on executors."""
    gc.collect()
    spark._jvm.System.gc()


#: Bytes of an Arrow batch of documents; a longer document is a batch by itself.
BATCH_BYTES = 8 << 20


def in_batches(df: DataFrame) -> DataFrame:
    """df, to be sent to Python workers in batches of bounded bytes, whatever the lengths of texts.

    The session's own bound stays where it is lower. The setting is read when the plan runs, so it can't be put back here.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(name, None)
    if not (now and now.isdigit() and 0 < int(now) <= BATCH_BYTES):
        conf.set(name, str(BATCH_BYTES))
    return df


#: A key is hot if more than this share of the rows have it, and at least so many: there are never more than HOT hot keys.
HOT, HOT_ROWS = 1024, 1000


def hot_keys(counts: DataFrame, key: str, total: int) -> dict:
    """The hot keys among counts (key, n), with the number of parts that their rows are dealt to."""
    bound = max(HOT_ROWS, total // HOT)
    return {r[key]: -(-r["n"] // bound) for r in counts.filter(F.col("n") > bound).select(key, "n").collect()}


def parts_of(key: Column, hot: dict) -> Column:
    """How many parts the rows of a key are dealt to: one, but for hot keys."""
    if not hot:
        return F.lit(1)
    listed = F.create_map(*[F.lit(x) for item in hot.items() for x in item])
    return F.coalesce(F.try_element_at(listed, key), F.lit(1))


def spread_join(left: DataFrame, right: DataFrame, key: str, hot: dict, by: Column, how: str = "inner") -> DataFrame:
    """left joined with right on key; rows of left with a hot key are dealt by a hash of ``by``, those of right go to all parts."""
    if not hot:
        return left.join(right, key, how)
    one = left.withColumn("__part", F.pmod(F.xxhash64(by), parts_of(F.col(key), hot)).cast("int"))
    many = right.withColumn("__part", F.explode(F.sequence(F.lit(0), parts_of(F.col(key), hot) - 1)))
    return one.join(many, [key, "__part"], how).drop("__part")
