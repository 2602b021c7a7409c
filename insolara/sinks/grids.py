"""Gridded tables laid out for reading few cells."""

from __future__ import annotations

from pyspark.sql import DataFrame

from insolara.operators.grid import TILE, tiled


def write_cells(grid: DataFrame, path: str, tile: int = TILE, time: str = "time", mode: str = "overwrite") -> None:
    """A grid as folders of ``tile`` x ``tile`` cells, rows in order of cell and time.

    Reading some stations touches only the folders of their tiles, and within a file only the row groups of
    their cells. The number of folders is that of the grid's tiles, whatever the number of time steps; the
    rebalance hint splits a heavy tile over several files.
    """
    parts = tiled(grid, tile)
    (parts.hint("rebalance", "tile").sortWithinPartitions("tile", "iy", "ix", time)
     .write.mode(mode).partitionBy("tile").parquet(path))
