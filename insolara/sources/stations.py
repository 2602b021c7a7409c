"""Station catalogs whose columns are known by position only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column positions (from 1) in the three catalog layouts.
LAYOUTS = {
    "model_new": {"station_id": 1, "lon": 2, "lat": 3},
    "model_old": {"station_id": 1, "name": 2, "lat": 3, "lon": 4},
    "satellite": {"station_id": 1, "name": 2, "lat": 6, "lon": 7},
}

_TYPES = {"station_id": "bigint", "name": "string", "lat": "double", "lon": "double", "altitude": "double"}


def read_stations(spark: SparkSession, path: str, positions: str | Mapping[str, int]) -> DataFrame:
    """Read a catalog, skip its header and name columns by position."""
    where = LAYOUTS[positions] if isinstance(positions, str) else dict(positions)
    width = max(where.values())
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(1, width + 1)])
    raw = spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)
    picked = {name: F.trim(F.col(f"c{at}")).cast(_TYPES[name]) for name, at in where.items()}
    return raw.select(*[picked.get(name, F.lit(None).cast(kind)).alias(name) for name, kind in _TYPES.items()])
