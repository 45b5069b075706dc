"""Sessions: making the package importable on the workers, and using all cores for small inputs."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the workers once per application, as an archive.

    Only in local mode are the driver's PYTHONPATH and working folder known to be the workers' too; nothing is sent where
    one of them holds the package.
    """
    root = Path(__file__).resolve().parent.parent
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    seen = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if spark.sparkContext.master.split("[")[0] == "local" and any(p and Path(p).resolve() == root for p in seen):
        return
    archive = Path(tempfile.mkdtemp(prefix="structlens-")) / "structlens_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted((root / "structlens").rglob("*.py")):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores if it is so small that its scan would use less than a quarter of them.

    Only the planner's size estimate is asked for; an input of the size of the cluster is left as it is.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return df.repartition(cores) if size < split * cores / 4 else df
