"""What an operator returns besides its rows: a report of what it left out, could not match or refuses."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Refusal(ValueError):
    """The operator declines: the declaration is wrong whatever the data hold."""


@dataclass
class OpResult:
    """Rows, and named lazy reports about them (each a small DataFrame), so that asking for one costs a job only then."""

    df: DataFrame
    report: dict[str, DataFrame] = field(default_factory=dict)


def refuse_when(condition: Column, message: str | Column, value: Column) -> Column:
    """value, with the job ending in an error where the condition holds: the refusal is part of the plan."""
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(~F.coalesce(condition, F.lit(False)), value).otherwise(F.raise_error(text))


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that the cluster shares (``spark.checkpoint.dir``); only where that is unset, one of this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        import tempfile

        folder = "file://" + tempfile.mkdtemp(prefix="tallygrove-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read again, which ends its lineage."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
