"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

#: Temporary folders of local sessions without the setting, by application.
_LOCAL: dict[str, str] = {}


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once under ``spark.checkpoint.dir``, as a scan of it.

    What is read several times is computed once, and plans over it stay small. A ``local``
    session without the setting gets a temporary folder; on a cluster ``df`` itself is
    returned, since executors share no other folder.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            return df
        folder = _LOCAL.setdefault(app, _LOCAL.get(app) or tempfile.mkdtemp(prefix="quarrylink-"))
    path = f"{folder.rstrip('/')}/quarrylink/{app}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
