"""Per-cell treatment model: yields, costs, totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from landstrata.operators.profile import normalize_by_max

# Treatment table and prices.
TREATMENTS = [
    {"name": "conservation burn", "production_rate": 2.4, "risk_reduction_rate": 0.90, "biomass_rate": 0.90, "biochar_rate": 0.03,
     "drag_distance_cost": 0.005, "water_distance_cost": 0.05, "air_pollution": 8.0, "cost_rate": 3000.0},
    {"name": "ring of fire kiln", "production_rate": 16.0, "risk_reduction_rate": 0.80, "biomass_rate": 0.80, "biochar_rate": 0.10,
     "drag_distance_cost": 0.05, "water_distance_cost": 0.02, "air_pollution": 4.0, "cost_rate": 600.0},
    {"name": "trailer kiln", "production_rate": 8.0, "risk_reduction_rate": 0.90, "biomass_rate": 0.90, "biochar_rate": 0.30,
     "drag_distance_cost": 0.03, "water_distance_cost": 0.01, "air_pollution": 2.0, "cost_rate": 1000.0},
    {"name": "chop and leave", "production_rate": 20.0, "risk_reduction_rate": 0.50, "biomass_rate": 0.01, "biochar_rate": 0.0,
     "drag_distance_cost": 0.0001, "water_distance_cost": 0.005, "air_pollution": 1.0, "cost_rate": 300.0},
]
FUEL_PRICE = 0.001
BIOCHAR_PRICE = 0.01
HOURS = 8.0

RATES = ("production_rate", "risk_reduction_rate", "biomass_rate", "biochar_rate", "drag_distance_cost",
         "water_distance_cost", "air_pollution", "cost_rate")
MEASURES = ("budget_cost", "biomass_extracted", "biochar_extracted", "air_pollution", "risk_reduced", "biomass_sale", "biochar_sale")


def with_treatments(cells: DataFrame, treatments: list[dict] | None = None) -> DataFrame:
    """Every cell with every treatment. The treatments are configuration, so they are a literal array to explode and
    no join is needed."""
    rows = F.array(
        *[
            F.struct(F.lit(t["name"]).alias("name"), *[F.lit(float(t[k])).alias(k) for k in RATES])
            for t in (TREATMENTS if treatments is None else treatments)
        ]
    )
    return cells.withColumn("t", F.explode(rows))


def cell_yields(
    cells: DataFrame, water: str = "creek_distance", drag: str = "roads_distance", fuel: str | None = None, treatments: list[dict] | None = None
) -> DataFrame:
    """The measures of each cell under each treatment; fuel mass is 1.0 where no column is named."""
    mass = F.lit(1.0) if fuel is None else F.col(fuel)
    t = {k: F.col("t")[k] for k in RATES}
    rate = t["production_rate"] + F.col(water) * t["water_distance_cost"] + F.col(drag) * t["drag_distance_cost"]
    biomass = mass * t["biomass_rate"]
    biochar = t["biochar_rate"] * biomass
    return (
        with_treatments(cells, treatments)
        .withColumns(
            {
                "treatment": F.col("t.name"),
                "budget_cost": rate * (t["cost_rate"] / F.lit(HOURS)),
                "biomass_extracted": biomass,
                "biochar_extracted": biochar,
                "air_pollution": t["air_pollution"] * biomass,
                "risk_reduced": mass * t["risk_reduction_rate"],
                "biomass_sale": F.lit(FUEL_PRICE) * biomass,
                "biochar_sale": F.lit(BIOCHAR_PRICE) * biochar,
            }
        )
        .drop("t")
    )


def totals(yields: DataFrame) -> DataFrame:
    return yields.groupBy("treatment").agg(*[F.sum(m).alias(m) for m in MEASURES])


def normalized_totals(yields: DataFrame) -> DataFrame:
    """Totals over the greatest total of each measure."""
    return normalize_by_max(totals(yields), list(MEASURES))


def long_totals(yields: DataFrame) -> DataFrame:
    """Totals as ``treatment, measure, value``."""
    return totals(yields).unpivot("treatment", list(MEASURES), "measure", "value")


def measure_table(yields: DataFrame, treatments: list[str] | None = None) -> DataFrame:
    """Measures by treatments."""
    names = treatments or [t["name"] for t in TREATMENTS]
    return long_totals(yields).groupBy("measure").pivot("treatment", names).agg(F.sum("value"))
