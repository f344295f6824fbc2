"""Makes this package importable on the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()

#: Rows that go to a Python worker at a time, where the session leaves Spark's default: documents are long rows.
BATCH_SETTING, SPARK_ROWS, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2500"


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package to the Python workers, once for each application; Spark's own file server deals it out."""
    context = spark.sparkContext
    if spark.conf.get(BATCH_SETTING, SPARK_ROWS) == SPARK_ROWS:
        spark.conf.set(BATCH_SETTING, ROWS)
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="folioscope-zip-")) / "folioscope.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, Path(root.name) / p.relative_to(root))
        context.addPyFile(str(target))
        _shipped.add(context.applicationId)
    return spark
