"""Read training records and the catalog of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chatloom.schema import TRAINING_RECORD

RUN_FOLDER = "run_id="


def read_train_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Training records, one JSON object per line; splittable."""
    return spark.read.schema(TRAINING_RECORD).json(path)


def list_runs(spark: SparkSession, base: str) -> DataFrame:
    """Sorted distinct run ids: the first level of an output folder, listed once."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(base)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in store.listStatus(folder) if s.isDirectory()]
    ids = [(n.removeprefix(RUN_FOLDER),) for n in names if n.startswith(RUN_FOLDER)]
    return spark.createDataFrame(ids, "run_id string").distinct().orderBy("run_id")
