"""Written tables that cut lineage, in the folder every executor shares."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of an Arrow batch that goes to a Python worker, about (a session setting of Spark's own).
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Only where it is unset a folder beside the warehouse,
    and that only where all executors are threads of this process, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + os.path.join(os.environ.get("TMPDIR", "/tmp"), f"quillspark-{uuid.uuid4().hex}")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, so that later steps neither
    recompute it nor depend on the executors that made it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder. Arrow batches are bounded by bytes from here on, not by rows alone: a
    batch of very long texts would fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key() -> "F.Column":
    """Tells rows with one doc_id and different texts apart; equal rows count as one document."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.col("text").isNull())


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names for an operator's own use that no column of ``df`` has, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        k = 0
        while f"_{name}{k}" in taken:
            k += 1
        taken.add(f"_{name}{k}")
        out.append(f"_{name}{k}")
    return out


def columns(names: list[str]) -> list["F.Column"]:
    """Columns by their plain names, dots and blanks included."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def apart(df: DataFrame, *keys: str) -> DataFrame:
    """The same rows, with long ``keys`` as new values. What comes out of an aggregation or a join lies
    by its key already and would be joined or grouped there in the same stage, where a hot key can't be
    split; new values get a shuffle of their own, and the join's larger side can be."""
    return df.withColumns({k: F.col(k).bitwiseXOR(F.lit(0).cast("long")) for k in keys})
