"""Written tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """df written as Parquet under spark.checkpoint.dir and read back. Where that is unset, a local session gets a temporary
    folder and a cluster a folder in its warehouse."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        local = spark.sparkContext.master.split("[")[0] == "local"
        root = tempfile.mkdtemp(prefix="mirrorfall-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/mirrorfall-scratch"
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/mirrorfall-step-{uuid.uuid4().hex[:12]}"

    def drop() -> None:
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session is gone
            pass

    atexit.register(drop)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
