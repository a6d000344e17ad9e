"""The package itself, for Python workers on other machines."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

NAME = "granary_engine.zip"
BATCH_BYTES, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of all executors, once for each Spark application.

    Also bounds what goes to Python at once in bytes, unless the session has a lower bound: a row count alone bounds nothing
    where texts are long.
    """
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_BYTES)) > BATCH:
        spark.conf.set(BATCH_BYTES, str(BATCH))
    sc = spark.sparkContext
    if any(f.rsplit("/", 1)[-1] == NAME for f in sc._python_includes):
        return
    package = Path(__file__).resolve().parent.parent
    path = Path(tempfile.mkdtemp(prefix="granary-code-")) / NAME
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f"{package.name}/{f.relative_to(package)}")
    sc.addPyFile(str(path))
