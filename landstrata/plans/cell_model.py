"""From layers to the treatment model: hexagon covers, distances to lines, yields and totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from landstrata.operators import cells, treatment
from landstrata.operators.profile import merge_distances
from landstrata.operators.skew import attach_group_values
from landstrata.session import cut_lineage


def cell_table(areas: DataFrame, area_id: str, roads: DataFrame, creeks: DataFrame, start: int = 8, max_cells: int = 10, line_res: int = 8, geom: str = "geom") -> DataFrame:
    """Cells of the areas with their grid distance to road and creek cells (both covers of line layers)."""
    area_cells = cut_lineage(
        cells.each_cell(cells.cover(areas.select(area_id, geom), geom, start, max_cells))
        .select(area_id, "res", F.col("c.q").alias("q"), F.col("c.r").alias("r"))
    )
    line_cells = lambda df: cells.line_cover(df, [], geom, line_res)
    near_road = cells.nearest_cell_distance(area_cells, line_cells(roads), "roads_distance")
    near_creek = cells.nearest_cell_distance(area_cells, line_cells(creeks), "creek_distance")
    # Both have one row a cell; the areas on a cell, of any number, are spread over salts when they get theirs.
    near = near_road.join(near_creek, ["res", "q", "r"])
    return attach_group_values(area_cells, near, ["res", "q", "r"], F.col(area_id), salts=4, how="left")


def treatment_totals(table: DataFrame, normalized: bool = False) -> DataFrame:
    yields = treatment.cell_yields(table)
    return treatment.normalized_totals(yields) if normalized else treatment.totals(yields)


def haul(table: DataFrame) -> DataFrame:
    return merge_distances(table, "roads_distance", "creek_distance", "haul")
