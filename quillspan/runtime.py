"""Session, reading and lineage helpers shared by all operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "quillspan", **conf: str) -> SparkSession:
    """Session with the settings the operators rely on; ``conf`` keys use ``__`` for dots."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of this session, which all executors share.

    It is the session's ``spark.checkpoint.dir``. Only a local session that names none gets
    a temporary folder of its own; a cluster must name a shared one.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="quillspan-checkpoint-")
        sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and return it without its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once a row, however often it is used after.

    A generator over one element keeps the optimizer from copying the expression into
    every place that refers to it, filters included.
    """
    return df.withColumn(name, F.explode(F.array(value)))


def delivered_once(df: DataFrame, key: str) -> DataFrame:
    """``df`` with rows that were delivered repeatedly, unchanged, counted once.

    Rows of null key have nothing that shows a repeat and all stay. Different rows under
    one key stay too. The comparison is by hash, without sorting the columns.
    """
    lone = F.when(F.col(key).isNull(), F.monotonically_increasing_id())
    return df.withColumn("_lone", lone).distinct().drop("_lone")
