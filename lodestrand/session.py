"""Getting this package to Spark's Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent
#: Bytes of an Arrow batch, unless the session says otherwise than Spark's default: batches of whole texts are held by the JVM and by Python.
ARROW_BYTES, DEFAULT_BYTES = "4194304b", "67108864b"
_ready: set[str] = set()


def ready(spark: SparkSession) -> SparkSession:
    """Send the package to the workers, once an application, unless their PYTHONPATH has it; keep Arrow batches small."""
    context = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == DEFAULT_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    on_path = str(ROOT.parent) in [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if on_path or context.applicationId in _ready:
        return spark
    made = Path(tempfile.mkdtemp(prefix="lodestrand-")) / "lodestrand.zip"
    with zipfile.ZipFile(made, "w") as out:
        for path in sorted(ROOT.rglob("*.py")):
            out.write(path, path.relative_to(ROOT.parent))
    context.addPyFile(str(made))
    _ready.add(context.applicationId)
    return spark
