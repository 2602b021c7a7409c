"""Load scaler and network parameters written by :mod:`insolara.sinks.models`."""

from __future__ import annotations

from pyspark.sql import SparkSession

from insolara.operators.network import Network
from insolara.operators.stats import Scaler


def load_scaler(spark: SparkSession, path: str) -> Scaler:
    row = spark.read.parquet(path).first()
    return Scaler(columns=list(row["columns"]), means=list(row["means"]), scales=list(row["scales"]))


def load_model(spark: SparkSession, path: str) -> Network:
    row = spark.read.parquet(path).first()
    return Network.from_flat(sizes=list(row["sizes"]), activation=row["activation"], flat=list(row["weights"]))
