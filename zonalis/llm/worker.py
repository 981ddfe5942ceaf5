"""What a Python worker keeps from one task to the next."""

from __future__ import annotations

import sys
import types

from pyspark.sql import SparkSession

#: Bytes of an Arrow batch between Spark and its Python workers.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Let this session cut Arrow batches by bytes too: ten thousand long texts are no small batch.

    A smaller bound that the session has already stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name, "2147483647")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def kept(name: str, make):
    """The object of that name in this worker process, made on first use.

    Task functions travel by value, so their module's globals are new in every task; tokenizers and
    lookup tables are worth keeping longer. What is kept must be bounded and hold no result.
    """
    store = sys.modules.setdefault("zonalis_worker_store", types.ModuleType("zonalis_worker_store"))
    if not hasattr(store, name):
        setattr(store, name, make())
    return getattr(store, name)
