"""Session plumbing shared by the operators: inputs, storage between steps, batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

from ..shared import scratch, shared_dir, ship

__all__ = ["parallelism", "prepare", "release", "save", "scratch", "shared_dir", "table", "tidied", "unused"]

#: Rows of one Arrow batch handed to Python; texts can be long, so batches stay small.
BATCH_ROWS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole input table, by Spark's own reader (any store Spark can read)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Make the session ready for Python stages: the package on every executor, and batches of at most BATCH_ROWS rows.

    The batch size is a setting of the session that Spark reads when a plan runs, so it stays lowered.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    ship(spark)


def unused(columns: list[str], *names: str) -> list[str]:
    """Column names like those given that none of the columns has."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def save(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage is cut, and lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of steps whose results are saved."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function that, when the task ends, hands what its worker has freed back to the system: Spark keeps its
    Python workers for later tasks, and allocators keep freed memory."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            import ctypes
            import gc

            import pyarrow as pa

            gc.collect()
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return wrapped


def parallelism(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)
