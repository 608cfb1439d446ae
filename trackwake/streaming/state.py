"""Where streaming queries keep their state."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Start queries inside this block; their state goes to RocksDB.

    The setting is read when a query starts, so the session gets its own value
    back right after.
    """
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def start(spark: SparkSession, writer: DataStreamWriter) -> StreamingQuery:
    """Start a query with its state in RocksDB, off the heap and without a bound."""
    with rocksdb_state(spark):
        return writer.start()
