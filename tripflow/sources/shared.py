"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that driver and executors share.

    It is ``spark.checkpoint.dir``. A folder of this machine serves only where
    that is unset and everything runs on this machine, as in tests.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def written(df: DataFrame, folder: str) -> DataFrame:
    """``df`` as Parquet in ``folder``, read again."""
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared folder and go on from its files.

    Later jobs read the files, so neither a lost executor nor a second use
    computes it again. A plan that starts from files also takes its size from
    them: an estimate handed on from plan to plan would multiply with every join
    of a loop. `discard` deletes the files.
    """
    folder = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    out = written(df, folder)
    out.cut_folder = folder
    return out


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*cuts: DataFrame) -> None:
    """Delete the files of cuts that no later job reads."""
    for df in cuts:
        delete_folder(df.sparkSession, df.cut_folder)


def partition_folders(spark: SparkSession, folder: str, column: str) -> dict[str, str]:
    """The folders of a table partitioned by a text column, by value."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{column}=*")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return {unquote(s.getPath().getName().split("=", 1)[1]): s.getPath().toString() for s in found}
