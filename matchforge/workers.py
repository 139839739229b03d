"""What Python workers and lost executors ask for: the package in the workers, and a shared folder for what was worked out."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application."""
    context = spark.sparkContext
    env = context.environment
    if env.get("MATCHFORGE_SHIPPED") != context.applicationId:
        made = Path(tempfile.mkdtemp()) / f"{PACKAGE.name}.zip"
        with zipfile.ZipFile(made, "w") as z:
            for f in sorted(PACKAGE.rglob("*.py")):
                z.write(f, str(f.relative_to(PACKAGE.parent)))
        context.addPyFile(str(made))
        env["MATCHFORGE_SHIPPED"] = context.applicationId


def scratch(spark: SparkSession) -> str:
    """A new path in the folder of spark.checkpoint.dir, which all machines share. A local master may do without the setting."""
    context = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not given:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        given = "file://" + tempfile.gettempdir() + "/checkpoints"
    return f"{given.rstrip('/')}/matchforge-{context.applicationId}/c-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to a path of ``scratch`` and read back, so its lineage ends there."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
