"""Tables in the cluster's shared folder, size-checked broadcasts and joins with hot keys."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []
#: What stored() has made: tables by application, name and state of the input folder.
_made: dict[tuple, object] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of this application below spark.checkpoint.dir.

    Where that is unset, a local session (tests, one machine) gets a temporary folder; a cluster gets an error, as a
    folder of one machine would split or lose tables there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return f"{named.rstrip('/')}/{spark.sparkContext.applicationId}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="stratalith-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return "file://" + _own[0]


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors, is computed once."""
    path = f"{shared_dir(df.sparkSession)}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _state(spark: SparkSession, folder: str) -> tuple:
    """Bytes, files and time of a folder: another state, another input."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    size = fs.getContentSummary(path)
    return size.getLength(), size.getFileCount(), fs.getFileStatus(path).getModificationTime()


def stored(spark: SparkSession, name: str, folder: str, make):
    """What make() returns (tables that it writes), made once a session for each state of the input folder, until clean()."""
    key = (spark.sparkContext.applicationId, name, folder, *_state(spark, folder))
    if key not in _made:
        _made[key] = make()
    return _made[key]


def clean(spark: SparkSession) -> None:
    """Deletes what written() has put into the shared folder; results that still read from there are void then."""
    for key in [k for k in _made if k[0] == spark.sparkContext.applicationId]:
        del _made[key]
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int, most: int = 2_000_000) -> DataFrame:
    """df with a broadcast hint if its counted, narrow rows are within the bound; else as it is, for a shuffled join."""
    return F.broadcast(df) if rows <= most else df


def dealt(df: DataFrame, *keys: str, rows: int = 20_000) -> DataFrame:
    """A written df dealt by its keys in tasks of about so many rows: for work that takes long for the bytes that it reads."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows)), *keys)


def dealt_join(left: DataFrame, right: DataFrame, keys: list[str], size: str, spread: list[str], most: int = 2000) -> DataFrame:
    """left LEFT JOIN right on non-null keys, each of which right has once; right's column `size` counts left's rows of a key.

    Keys with more than `most` rows are parted by a hash of the `spread` columns, with a copy of right's row for each
    part. There are at most rows / most such keys, and only they and their numbers of parts are broadcast.
    """
    parts = F.greatest(F.ceil(F.col(size) / most), F.lit(1)).cast("int")
    hot = written(right.filter(F.col(size) > most).select(*keys, parts.alias("__parts")))
    marked = left.join(small(hot, hot.count()), keys, "left")
    marked = marked.withColumn("__part", F.when(F.col("__parts") > 1, F.pmod(F.xxhash64(*spread), F.col("__parts")).cast("int")).otherwise(0)).drop("__parts")
    copies = right.withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop(size)
    return marked.join(copies, [*keys, "__part"], "left").drop("__part")
