"""Cell-type conversion of long-form cells; null is NoData and stays so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..types import CELL_RANGE


def cast_value(v: Column, cell_type: str, clamp: bool = True) -> Column:
    """Integers: to the nearest (halves away from zero), clamped to the type's range; floats: rounded to their precision."""
    if cell_type == "float64":
        return v
    if cell_type == "float32":
        return v.cast("float").cast("double")
    low, high = CELL_RANGE[cell_type]
    whole = F.signum(v) * F.floor(F.abs(v) + 0.5)
    out = F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), whole)) if clamp else whole
    return F.when(v.isNotNull(), out + F.lit(0.0))


def convert(cells: DataFrame, cell_type: str) -> DataFrame:
    return cells.withColumn("value", cast_value(F.col("value"), cell_type))


def convert_byte_only(cells: DataFrame, cell_type: str) -> DataFrame:
    """As a warp library without bits converts: bytes are unsigned, bits are refused."""
    if cell_type == "bit":
        raise ValueError("bit cells are not supported")
    return convert(cells, "uint8" if cell_type == "int8" else cell_type)


def nodata(cells: DataFrame, value: float) -> DataFrame:
    """A stored NoData value becomes null."""
    return cells.withColumn("value", F.nullif("value", F.lit(value)))
