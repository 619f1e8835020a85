"""Frames that kernels return, and frames that are computed once."""

import tempfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def frame(columns: dict, **_) -> pd.DataFrame:
    """Like ``pandas.DataFrame``, but columns without rows have no type of their own, so any Arrow type takes them."""
    out = pd.DataFrame(columns)
    return out if len(out) else out.astype(object)


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; only a local session that names none gets a temporary one."""
    sc = spark.sparkContext
    where = sc._jsc.sc().getCheckpointDir()
    if where.isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            named = tempfile.mkdtemp(prefix="faultline-")
        sc.setCheckpointDir(named)
        where = sc._jsc.sc().getCheckpointDir()
    return where.get()


def materialised(df: DataFrame) -> DataFrame:
    """``df`` computed once, into the shared folder, for plans that read it often."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
