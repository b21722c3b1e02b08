"""The folder that driver and executors share, for what is kept between jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Named by ``spark.checkpoint.dir``.  Where that is unset, a run on one machine (``local[...]``) takes a
    temporary folder; on a cluster it is an error."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not at:
        held = sc._jsc.sc().getCheckpointDir()
        if held.isDefined():
            at = held.get()
        elif sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
            at = f"file://{tempfile.mkdtemp(prefix='lattica-')}"
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(at)
    return at.rstrip("/")


#: How much larger rows of kept tables are than their files, where names repeat: 384 MB were broadcast of a file under 10 MB.
ROWS_TO_FILES = 50


def true_sizes(spark: SparkSession) -> None:
    """Has Spark take files for what their rows weigh when it judges what is small enough to broadcast; tables that turn out
    small are still broadcast at run time, by their rows.  What a session has set itself stays."""
    factor = "spark.sql.sources.fileCompressionFactor"
    if float(spark.conf.get(factor)) == 1.0:
        spark.conf.set(factor, str(float(ROWS_TO_FILES)))


def keep(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept in the shared folder: later reads survive a lost executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else has; ``clean`` removes it."""
    at = f"{shared_dir(spark)}/lattica-{name}-{uuid.uuid4().hex}"
    sc = spark.sparkContext
    sc._lattica_made = [*getattr(sc, "_lattica_made", []), at]
    return at


def clean(spark: SparkSession) -> None:
    """Removes all that this session has written on the way, at the end of a run: results that still read it must have been
    written elsewhere.  Checkpoints are removed by Spark, where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set."""
    sc = spark.sparkContext
    for at in getattr(sc, "_lattica_made", []):
        _delete(spark, at)
    sc._lattica_made = []


def _delete(spark: SparkSession, at: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, **told) -> DataFrame:
    """``df`` as a table in the shared folder, for rounds of a loop: a plan over it knows its true size, while that of
    a checkpoint is estimated from all rounds before and grows without end.

    ``told`` are aggregates, named, that are taken while it is written; their values are in the dict ``_lattica_told``, so that
    a loop need not read a table to see whether to go on."""
    spark = df.sparkSession
    true_sizes(spark)
    at = new_path(spark, "round")
    seen = Observation() if told else None
    (df.observe(seen, *[c.alias(n) for n, c in told.items()]) if told else df).write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out._lattica_at, out._lattica_told = at, seen.get if told else {}
    return out


def forget(*tables: DataFrame) -> None:
    """Removes tables of ``written`` that nothing reads any more."""
    for t in tables:
        if at := getattr(t, "_lattica_at", None):
            _delete(t.sparkSession, at)
