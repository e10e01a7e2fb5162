"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Shares that ``in_turns`` makes of tables of more than SMALL bytes.
TURNS, SMALL = 4, 1 << 26


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; where a local session names none, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: the lineage ends here, and the rows are computed once.

    The shuffle files of the finished write are freed at once, so disk holds one step's shuffles at a time.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def n_bytes(table: DataFrame) -> int:
    """Size of the files of a table that ``stored`` wrote."""
    jvm, conf = table.sparkSession.sparkContext._jvm, table.sparkSession.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(table._stored_at)
    return where.getFileSystem(conf).getContentSummary(where).getLength()


def shares(rows: DataFrame) -> int:
    """Into how many shares ``in_turns`` cuts stored rows: small tables into one, others into TURNS."""
    return TURNS if n_bytes(rows) > SMALL else 1


def in_turns(rows: DataFrame, key: str, make: Callable[[DataFrame], DataFrame], name: str, turns: int | None = None, view: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """``make`` of ``rows``, a share of the keys at a time, each share stored: disk holds the shuffles of one share only.

    ``rows`` are stored; every turn reads them all (through ``view``) and keeps its keys by hash, so rows of a key meet in
    one share.
    """
    n = turns or shares(rows)
    share = lambda k: view(rows) if n == 1 else view(rows).filter(F.pmod(F.xxhash64(key), F.lit(n)) == k)
    return functools.reduce(DataFrame.unionByName, [stored(make(share(k)), name) for k in range(n)])


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote, once nothing will read them again."""
    for table in tables:
        jvm, conf = table.sparkSession.sparkContext._jvm, table.sparkSession.sparkContext._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(table._stored_at)
        where.getFileSystem(conf).delete(where, True)
