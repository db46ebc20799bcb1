"""What several operators of this subpackage take from the library, and the size of batches of texts."""

from pyspark.sql import SparkSession

from ..operators.graph import connected_components
from ..storage import forget, fresh_path, saved, shared_dir

__all__ = ["bounded_batches", "connected_components", "forget", "fresh_path", "saved", "shared_dir"]

BATCH_ROWS = 4000


def bounded_batches(spark: SparkSession) -> None:
    """Has the session send at most ``BATCH_ROWS`` rows at once to Python: batches of whole texts stay some megabytes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
