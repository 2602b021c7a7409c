"""Save scaler and network parameters as one-row parquet (never pickled code)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from insolara.operators.network import Network
from insolara.operators.stats import Scaler

_SCALER = T.StructType([
    T.StructField("columns", T.ArrayType(T.StringType())),
    T.StructField("means", T.ArrayType(T.DoubleType())),
    T.StructField("scales", T.ArrayType(T.DoubleType())),
])
_MODEL = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("sizes", T.ArrayType(T.IntegerType())),
    T.StructField("activation", T.StringType()),
    T.StructField("weights", T.ArrayType(T.DoubleType())),
    T.StructField("r2", T.DoubleType()),
])


def save_scaler(spark: SparkSession, scaler: Scaler, path: str) -> None:
    row = (scaler.columns, scaler.means, scaler.scales)
    spark.createDataFrame([row], _SCALER).coalesce(1).write.mode("overwrite").parquet(path)


def model_name(prefix: str, network: Network, r2: float) -> str:
    """Name with the layer sizes, the activation and the training R2."""
    return f"{prefix}-{'-'.join(str(s) for s in network.sizes)}-{network.activation}-r2-{r2:.3f}"


def save_model(spark: SparkSession, network: Network, folder: str, prefix: str, r2: float) -> str:
    """Write the network below ``folder`` and return the full path."""
    name = model_name(prefix, network, r2)
    path = f"{folder.rstrip('/')}/{name}"
    row = (name, network.sizes, network.activation, [float(w) for w in network.flat()], float(r2))
    spark.createDataFrame([row], _MODEL).coalesce(1).write.mode("overwrite").parquet(path)
    return path
