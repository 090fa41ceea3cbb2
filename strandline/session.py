"""Sessions for local use, and shipping this package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent


def local_session(cpus: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("strandline")
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | conf
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


#: Bytes of an Arrow batch that a Python worker gets, where the session sets nothing else.
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> None:
    """Sends the package to all executors, once for each context, so that Python workers can import it.

    Arrow batches are bounded by bytes as well as by rows, since a row may be a long text;
    a session's own setting stays.
    """
    context = spark.sparkContext
    if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", str(2**31 - 1))) == 2**31 - 1:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    if getattr(context, "_strandline_shipped", False):
        return
    path = os.path.join(tempfile.mkdtemp(), "strandline.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(_PACKAGE.rglob("*.py")):
            z.write(f, f.relative_to(_PACKAGE.parent))
    context.addPyFile(path)
    context._strandline_shipped = True
