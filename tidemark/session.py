"""Session settings the jobs rely on."""

from pyspark.sql import SparkSession

# Results must not depend on where the driver runs.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

# Python call sites attached to each column: they only enrich error messages,
# and cost about a millisecond per column operation.
QUIET_CONF = {
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.dataFrameQueryContext.enabled": "false",
}


def builder(app_name="tidemark"):
    """A builder with the recommended settings; the master and memory stay with the caller."""
    b = SparkSession.builder.appName(app_name).config("spark.ui.enabled", "false")
    for key, value in (RUNTIME_CONF | QUIET_CONF).items():
        b = b.config(key, value)
    return b


def pin_runtime(spark):
    """Apply the result-relevant settings to a session built elsewhere."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark
