"""Table schemas and column handling."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

# Header of the order file -> column name here.
ORDER_HEADERS = {
    "date_dos": "date_dos",
    "cnr_tour": "cnr_tour",
    "cnr_cust": "cnr_cust",
    "RFX Activity": "rfx_activity",
    "RFX Year": "rfx_year",
    "RFX Preperation": "rfx_preparation",
    "nm_short_unload": "nm_short_unload",
    "Win FROM": "win_from",
    "Win UNTIL": "win_until",
    "Planned": "planned",
    "P_Depart": "p_depart",
    "DurationP": "duration_p",
    "Actual": "actual",
    "A_Depart": "a_depart",
    "DurationA": "duration_a",
}
# Second spelling of the same column in some files.
HEADER_ALIASES = {"duration_A": "duration_a"}

ORDER_COLUMNS = list(ORDER_HEADERS.values())
ID_COLUMNS = ["cnr_tour", "cnr_cust", "rfx_activity", "rfx_year", "rfx_preparation"]
CLOCK_COLUMNS = ["win_from", "win_until", "planned", "actual", "p_depart", "a_depart"]

DURATION_COLUMNS = ["duration_p", "duration_a"]

# What ingest reads out of the texts once: seconds of the day, and minutes as numbers.
TYPED_FIELDS = [T.StructField(f"{c}_sec", T.IntegerType()) for c in CLOCK_COLUMNS] + [
    T.StructField(f"{c}_num", T.DoubleType()) for c in DURATION_COLUMNS
]
TYPED_COLUMNS = [f.name for f in TYPED_FIELDS]

# row_ord is the position in the ingested file; every "first" value is taken by it.
ORDERS_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ORDER_COLUMNS] + [T.StructField("row_ord", T.LongType())]
)

DELIVERY_COLUMNS = [
    "uid", "cnr_tour", "cnr_cust", "nm_short_unload", "customer", "site", "planned_time",
    "actual_time", "date_dos", "raw_planned", "raw_actual", "payload_json", "created_at", "updated_at",
]
DELIVERIES_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in DELIVERY_COLUMNS])

ROUTE = ["date_dos", "cnr_tour"]
STOP = ["date_dos", "cnr_tour", "nm_short_unload"]


def require(df: DataFrame, names: list[str], message: str) -> None:
    """Raises ``ValueError`` naming the absent columns; looks at the schema only."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{message}: {', '.join(missing)}")


def with_optional(df: DataFrame, *names: str) -> DataFrame:
    """Adds absent columns as NULL text."""
    return df.withColumns({n: F.lit(None).cast("string") for n in names if n not in df.columns})


def present(df: DataFrame, *names: str) -> DataFrame:
    """Rows whose named columns are all filled."""
    for n in names:
        df = df.where(F.col(n).isNotNull())
    return df
