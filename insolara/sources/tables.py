"""Station-hour tables: parquet or a database table, selected and filtered at the scan."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from insolara.functions.nulls import clean_frame

# Two stations with too many gaps.
GAPPY_STATIONS = (97419380, 97412384)


def station_query(spark: SparkSession, table: str | Mapping[str, str], columns: Mapping[str, str | Column],
                  where: Column | None = None, drop_stations: Iterable[int] = ()) -> DataFrame:
    """Project and filter a station-hour table.

    ``table`` is a parquet path, a catalog name, or JDBC reader options (give
    ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions``
    there for a parallel read; credentials belong in the options as well).
    ``columns`` maps output names to source columns or expressions. The filters
    sit directly on the scan, so the source receives them.
    """
    if isinstance(table, Mapping):
        source = spark.read.format("jdbc").options(**table).load()
    elif "/" in table:
        source = spark.read.parquet(table)
    else:
        source = spark.table(table)
    if where is not None:
        source = source.where(where)
    out = source.select(*[(c if isinstance(c, Column) else F.col(c)).alias(name) for name, c in columns.items()])
    bad = [int(s) for s in drop_stations]
    if bad:
        out = out.where(~F.col("station_id").isin(bad))
    return clean_frame(out)
