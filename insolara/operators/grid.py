"""Grid cells of stations, station series from grids, and gridded climatologies."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from insolara.functions import columns as C
from insolara.functions.timecol import LOCAL_ZONE, utc_to_local
from insolara.operators.filters import at_hour, at_time, bbox, stride
from insolara.operators.stations import station_hour_mean


@dataclass(frozen=True)
class Axis:
    """A regular axis: the coordinate of index ``i`` is ``start + i * step`` for 0 <= i < n."""

    start: float
    step: float
    n: int

    def coordinate(self, index: Column) -> Column:
        return F.lit(self.start) + index * F.lit(self.step)


@dataclass(frozen=True)
class SpanAxis:
    """An axis given by two ends and a count; index ``j`` lies at ``start + (j + 1) * (end - start) / n``."""

    start: float
    end: float
    n: int

    def coordinate(self, index: Column) -> Column:
        return F.lit(self.start) + (index + 1) * F.lit(self.end - self.start) / F.lit(self.n)


# Ends and size of the inner model grid, and the search width.
MODEL_LON = SpanAxis(55.02496, 56.04868, 140)
MODEL_LAT = SpanAxis(-21.59586, -20.64304, 140)
SEARCH_RESO = 0.05


def first_match(location: Column, axis: SpanAxis, reso: float = SEARCH_RESO) -> Column:
    """First index from 1 whose coordinate is within half of ``reso``; NULL if none is.

    The index follows from the axis arithmetic; its two neighbours are tested
    with the same comparison as a search would use, so rounding cannot shift it.
    """
    half = reso / 2
    width = (axis.end - axis.start) / axis.n
    near_edge = location - half if width > 0 else location + half
    guess = (F.ceil((near_edge - F.lit(axis.start)) / F.lit(width)) - 1).cast("int")

    def fits(j: Column) -> Column:
        at = axis.coordinate(j)
        return j.between(1, axis.n - 1) & (at >= location - half) & (at <= location + half)

    options = [F.greatest(guess + shift, F.lit(1)) for shift in (-1, 0, 1)]
    return F.coalesce(*[F.when(fits(j), j) for j in options])


def nearest(location: Column, axis: Axis) -> Column:
    """Nearest index of a regular axis; NULL when the point is over half a step outside."""
    index = F.bround((location - F.lit(axis.start)) / F.lit(axis.step), 0).cast("int")
    return F.when(index.between(0, axis.n - 1), index)


def station_cell_first(stations: DataFrame, lon_axis: SpanAxis = MODEL_LON, lat_axis: SpanAxis = MODEL_LAT,
                       reso: float = SEARCH_RESO, swap_axes: bool = False) -> DataFrame:
    """Stations with the cell an index search from the start would stop at.

    ``swap_axes`` puts the longitude index on the outer array axis.
    """
    across = first_match(F.col("lon"), lon_axis, reso)
    along = first_match(F.col("lat"), lat_axis, reso)
    iy, ix = (across, along) if swap_axes else (along, across)
    return stations.withColumns({"iy": iy, "ix": ix})


def station_cell_nearest(stations: DataFrame, lon_axis: Axis, lat_axis: Axis) -> DataFrame:
    return stations.withColumns({"iy": nearest(F.col("lat"), lat_axis), "ix": nearest(F.col("lon"), lon_axis)})


def axis_vector(grid: DataFrame, index: str, coord: str, moment: str | None = None, time: str = "time") -> Column:
    """The axis of a grid table as one array of (``c``, ``i``), sorted by coordinate, to be used in any other frame.

    With ``moment`` only that time step is read, which holds every index of a whole field. It has one entry
    per index, so its size is that of the axis, not of the data.
    """
    rows = at_time(grid, [moment], time) if moment else grid
    entries = rows.groupBy(F.col(index).cast("int").alias("i")).agg(F.min(F.col(coord).cast("double")).alias("c"))
    return entries.agg(F.sort_array(F.collect_list(F.struct("c", "i")))).scalar()


def axis_literal(coordinates: Sequence[float]) -> Column:
    """The same from a coordinate vector at hand."""
    order = sorted(range(len(coordinates)), key=lambda i: (coordinates[i], i))
    return F.array(*[F.struct(F.lit(float(coordinates[i])).alias("c"), F.lit(i).alias("i")) for i in order])


def _place(axis: Column, value: Column) -> Column:
    """First place (from 1) of a sorted axis whose coordinate is at least ``value``, one past the end if none is.

    A binary search: as many steps as the axis has binary digits.
    """
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(axis) + F.lit(1.0))).cast("int") + 1)

    def halve(state: Column, _: Column) -> Column:
        middle = F.floor((state["lo"] + state["hi"]) / 2).cast("int")
        below = F.get(axis, middle - 1)["c"] < value
        low = F.when((state["lo"] < state["hi"]) & below, middle + 1).otherwise(state["lo"])
        high = F.when((state["lo"] < state["hi"]) & ~below, middle).otherwise(state["hi"])
        return F.struct(low.alias("lo"), high.alias("hi"))

    start = F.struct(F.lit(1).alias("lo"), (F.size(axis) + 1).alias("hi"))
    return F.aggregate(steps, start, halve)["lo"]


def nearest_on_axis(location: Column, axis: Column, reach: float) -> Column:
    """Index of the nearest entry of an irregular axis within ``reach``; the smaller index on a tie.

    A search in the sorted axis vector: stations need neither a join nor a shuffle. Entries at the nearest
    coordinate on either side decide, all those of one coordinate together.
    """
    at = _place(axis, location)
    above, below = F.get(axis, at - 1)["c"], F.get(axis, at - 2)["c"]
    gap = F.least(F.abs(above - location), F.abs(below - location))
    first, last = _place(axis, F.coalesce(below, above)), _place(axis, F.coalesce(above, below))
    near = F.slice(axis, first, last - first + F.size(F.filter(axis, lambda e: e["c"] == F.coalesce(above, below))))
    return F.array_min(F.transform(F.filter(near, lambda e: (F.abs(e["c"] - location) == gap) & (gap <= reach)), lambda e: e["i"]))


def first_in_box(location: Column, axis: Column, reso: float) -> Column:
    """First index whose coordinate lies within half of ``reso``."""
    half = reso / 2
    first = _place(axis, location - half)
    inside = F.filter(F.slice(axis, first, F.size(axis)), lambda e: e["c"] <= location + half)
    return F.array_min(F.transform(inside, lambda e: e["i"]))


def station_cell_box(stations: DataFrame, lon_axis: Column, lat_axis: Column,
                     reso: float = SEARCH_RESO) -> DataFrame:
    """First cell of the box of half ``reso`` around each station, as a cropped file would start with it.

    For grids whose coordinates are those of two axes; see :func:`cell_in_box` for others.
    """
    return (stations.withColumns({"_lat_axis": lat_axis, "_lon_axis": lon_axis})
            .withColumns({"iy": first_in_box(F.col("lat"), F.col("_lat_axis"), reso),
                          "ix": first_in_box(F.col("lon"), F.col("_lon_axis"), reso)})
            .drop("_lat_axis", "_lon_axis"))


def grid_cells(grid: DataFrame, moment: str | None = None, time: str = "time") -> DataFrame:
    """(iy, ix, lat, lon): every cell once, from one time step if ``moment`` names one.

    Without it one number per cell and task is combined before the shuffle.
    """
    rows = at_time(grid, [moment], time) if moment else grid
    return rows.groupBy(F.col("iy").cast("int").alias("iy"), F.col("ix").cast("int").alias("ix")).agg(
        F.min(F.col("lat").cast("double")).alias("lat"), F.min(F.col("lon").cast("double")).alias("lon"))


def cell_in_box(stations: DataFrame, cells: DataFrame, reso: float = SEARCH_RESO) -> DataFrame:
    """(station_id, iy, ix): the first cell, by row then column, within half of ``reso`` of each station that has one.

    Cells may lie anywhere (curvilinear grids). Both sides are put into bins as wide as the box; a box
    reaches into at most two bins a side, so each station is joined from at most four bins and each cell from
    one, and the bounds are tested on those pairs only.
    """
    half = reso / 2

    def bins(c: str) -> Column:
        return F.explode(F.sequence(F.floor((F.col(c) - half) / reso), F.floor((F.col(c) + half) / reso)))

    spots = stations.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(
        "station_id", F.col("lat").cast("double").alias("_lat"), F.col("lon").cast("double").alias("_lon"))
    spots = spots.withColumnRenamed("_lat", "lat").withColumnRenamed("_lon", "lon")
    spots = spots.withColumn("by", bins("lat")).withColumn("bx", bins("lon")).select(
        "station_id", "by", "bx", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    placed = cells.withColumns({"by": F.floor(F.col("lat") / reso), "bx": F.floor(F.col("lon") / reso)})
    inside = F.col("lat").between(F.col("_lat") - half, F.col("_lat") + half) & \
        F.col("lon").between(F.col("_lon") - half, F.col("_lon") + half)
    wide = F.lit(1 << 32)
    first = F.min(F.col("iy").cast("long") * wide + F.col("ix"))  # one number, so that the aggregate hashes
    found = spots.join(placed, ["by", "bx"]).where(inside).groupBy("station_id").agg(first.alias("_cell"))
    return found.select("station_id", F.floor(F.col("_cell") / wide).cast("int").alias("iy"),
                        F.pmod("_cell", wide).cast("int").alias("ix"))


def unmatched(stations_with_cell: DataFrame) -> DataFrame:
    """Stations outside the grid."""
    return stations_with_cell.where(F.col("iy").isNull() | F.col("ix").isNull())


def extract_at_stations(grid: DataFrame, stations_with_cell: DataFrame, values: Sequence[str] = ("value",),
                        zone: str | None = LOCAL_ZONE, time: str = "time") -> DataFrame:
    """Series of every station in one job: the grid is read once and equi-joined on its cell.

    Times are shifted from UTC to ``zone`` (None keeps UTC). The station table is
    normally far below the broadcast threshold, which Spark checks itself; a
    larger one gets a shuffled join with skew splitting.
    """
    cells = (stations_with_cell.where(F.col("iy").isNotNull() & F.col("ix").isNotNull())
             .select("station_id", F.col("iy").cast("int").alias("iy"), F.col("ix").cast("int").alias("ix")))
    local = utc_to_local(F.col(time), zone) if zone else F.col(time)
    rows = grid.withColumns({"iy": F.col("iy").cast("int"), "ix": F.col("ix").cast("int")})
    return rows.join(cells, ["iy", "ix"]).select("station_id", local.alias("dt"), *values)


# Cells of a stored tile along each axis, and stations that are broadcast.
TILE = 4
MANY_STATIONS = 100_000


def tiled(df: DataFrame, tile: int = TILE) -> DataFrame:
    """The number of a cell's tile beside it (one number: pruning by row and column apart would keep their whole grid)."""
    row, column = (F.floor(F.col(c) / tile).cast("long") for c in ("iy", "ix"))
    return df.withColumn("tile", row * F.lit(1 << 20) + column)


def extract_stored(stored: DataFrame, stations_with_cell: DataFrame, values: Sequence[str] = ("value",),
                   zone: str | None = LOCAL_ZONE, time: str = "time", tile: int = TILE) -> DataFrame:
    """Like :func:`extract_at_stations` for a table of ``sinks.grids.write_cells``: only tiles with a station are read.

    The stations' tiles are part of the join, so that Spark prunes the folders of the stored table by them at
    run time. That needs a broadcast: up to MANY_STATIONS stations (counted) are, more get a shuffled join.
    """
    cells = tiled(stations_with_cell.where((F.col("iy") >= 0) & (F.col("ix") >= 0)).select(
        "station_id", F.col("iy").cast("int").alias("iy"), F.col("ix").cast("int").alias("ix")), tile)
    if cells.limit(MANY_STATIONS + 1).count() <= MANY_STATIONS:
        cells = F.broadcast(cells)
    local = utc_to_local(F.col(time), zone) if zone else F.col(time)
    return stored.join(cells, ["tile", "iy", "ix"]).select("station_id", local.alias("dt"), *values)


def cell_hour_mean(grid: DataFrame, values: Sequence[str] = ("value",), hours: Sequence[int] | None = None,
                   time: str = "time") -> DataFrame:
    """Mean per cell and hour of day."""
    rows = at_hour(grid, hours, time) if hours else grid
    return rows.groupBy("iy", "ix", F.hour(time).alias("hour")).agg(*[F.avg(v).alias(v) for v in values])


def cell_mean(grid: DataFrame, values: Sequence[str] = ("value",)) -> DataFrame:
    """Mean per cell over all time."""
    return grid.groupBy("iy", "ix").agg(*[F.avg(v).alias(v) for v in values])


def widen(grid: DataFrame, variables: Sequence[str], keys: Sequence[str] = ("time", "iy", "ix", "lat", "lon")) -> DataFrame:
    """Long grid (``var, value``) to one column per variable."""
    cells = [F.max(F.when(F.col("var") == v, F.col("value"))).alias(v) for v in variables]
    return grid.where(F.col("var").isin(list(variables))).groupBy(*keys).agg(*cells)


def monthly_field(grid: DataFrame, moments: Sequence[str], area: str | tuple | None = None, step: int = 1,
                  time: str = "time") -> DataFrame:
    """u, v and p of each month start, boxed and thinned, with the contour bands of u and p."""
    rows = at_time(grid, moments, time)
    if area is not None:
        rows = bbox(rows, area)
    rows = stride(rows, step)
    return rows.select(time, "iy", "ix", "lat", "lon", "u", "v", "p",
                       C.contour_class(F.col("u"), *C.CONTOURS["zonal_wind"]).alias("u_band"),
                       C.contour_class(F.col("p"), *C.CONTOURS["pressure"]).alias("p_band"))


def station_hour_cloud_bias(grid: DataFrame, station_rows: DataFrame, stations_with_cell: DataFrame, model: str,
                            observed: str, cloud: str = "value", hours: Sequence[int] = tuple(range(8, 18)),
                            reach: float = 240.0, n: int = 20, time: str = "time", dt: str = "dt") -> DataFrame:
    """Hourly mean bias of each station beside the hourly mean cloud cover of its cell."""
    biased = station_rows.where(F.hour(dt).isin(list(hours))).select(
        "station_id", dt, C.bias(F.col(model), F.col(observed)).alias("bias"))
    hourly = station_hour_mean(biased, ["bias"], dt)
    cloudy = cell_hour_mean(grid, [cloud], hours, time).withColumnRenamed(cloud, "cloud")
    cells = stations_with_cell.select("station_id", F.col("iy").cast("int").alias("iy"),
                                      F.col("ix").cast("int").alias("ix"))
    cloudy = cloudy.withColumns({"iy": F.col("iy").cast("int"), "ix": F.col("ix").cast("int")})
    return (hourly.join(cells, "station_id", "left").join(cloudy, ["iy", "ix", "hour"], "left")
            .select("station_id", "hour", "bias", "cloud",
                    C.contour_class(F.col("cloud"), *C.CONTOURS["cloud_hourly"]).alias("cloud_band"),
                    C.value_class(F.col("bias"), -reach, reach, n).alias("bias_class")))
