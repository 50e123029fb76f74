"""Session settings the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# UTC keeps hour arithmetic on zone-less timestamps independent of the host; ANSI turns silent overflow and
# division by zero into errors, which the operators avoid explicitly. A task that reads a kept table from disk holds up to a
# hundred of its batches; ten thousand rows of vectors each were 2 MB.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.inMemoryColumnarStorage.batchSize": "1000",
}

# Recording a Python call site for every column expression doubles the time it takes to build a plan.
BUILD_TIME = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def build_session(app: str = "riskmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the required settings; everything else is left to the cluster's defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**REQUIRED, **BUILD_TIME, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def pin_settings(spark: SparkSession) -> SparkSession:
    """Apply the required runtime settings to a session somebody else created."""
    for key, value in REQUIRED.items():
        spark.conf.set(key, value)
    return spark
