"""Tables that are computed once and kept in the folder all machines share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def stored(df: DataFrame) -> DataFrame:
    """``df`` computed once, its lineage cut. The folder is spark.checkpoint.dir; only a single
    process (``local``, as in tests) may do without."""
    spark = df.sparkSession
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        spark.sparkContext.setCheckpointDir(where or "file://" + tempfile.mkdtemp(prefix="loomwork-"))
    return df.checkpoint(eager=True)
