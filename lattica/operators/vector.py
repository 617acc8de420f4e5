"""Operators over tables of points and boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as geo


def delete_where(df: DataFrame, predicate: Column) -> DataFrame:
    """What a DELETE leaves: rows for which the predicate is false or null."""
    return df.where(~F.coalesce(predicate, F.lit(False)))


def insert(df: DataFrame, rows: DataFrame, key: str = "id", order: list[str] | None = None) -> DataFrame:
    """``df`` and ``rows``; rows without a key get the next numbers in the order given (a small batch: it is numbered in one task)."""
    given = rows.where(F.col(key).isNotNull()) if key in rows.columns else None
    fresh = rows.where(F.col(key).isNull()).drop(key) if key in rows.columns else rows
    top = df.agg(F.coalesce(F.max(key), F.lit(0)).alias("__top"))
    numbered = fresh.withColumn("__n", F.row_number().over(Window.orderBy(*(order or fresh.columns)))).join(F.broadcast(top)).withColumn(key, (F.col("__top") + F.col("__n")).cast(df.schema[key].dataType)).drop("__top", "__n")
    out = df.unionByName(numbered.select(*df.columns))
    return out if given is None else out.unionByName(given.select(*df.columns))


def distance_join(left: DataFrame, right: DataFrame, d: float) -> DataFrame:
    """Pairs of points within less than ``d``: (aid, bid, d).

    Points are dealt into square cells of side ``d``; a left point meets the
    3x3 cells around its own by an equi-join, and every pair is met once.
    """
    a = left.where("x is not null and y is not null").select(F.col("id").alias("aid"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = right.where("x is not null and y is not null").select(F.col("id").alias("bid"), F.col("x").alias("bx"), F.col("y").alias("by"))
    near = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    a = a.withColumn("near", near).withColumns({"gx": F.floor(F.col("ax") / d) + F.col("near.i"), "gy": F.floor(F.col("ay") / d) + F.col("near.j")})
    b = b.withColumns({"gx": F.floor(F.col("bx") / d), "gy": F.floor(F.col("by") / d)})
    out = a.join(b, ["gx", "gy"]).withColumn("d", geo.distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")))
    return out.where(F.col("d") < d).select("aid", "bid", "d")


def points_in_boxes(points: DataFrame, boxes: DataFrame, cell: float) -> DataFrame:
    """(box_id, id): points in boxes, by an equi-join on the grid cells that a box covers."""
    b = boxes.withColumn("gx", F.explode(F.sequence(F.floor(F.col("xmin") / cell), F.floor(F.col("xmax") / cell)))).withColumn("gy", F.explode(F.sequence(F.floor(F.col("ymin") / cell), F.floor(F.col("ymax") / cell))))
    p = points.where("x is not null and y is not null").withColumns({"gx": F.floor(F.col("x") / cell), "gy": F.floor(F.col("y") / cell)})
    return p.join(b, ["gx", "gy"]).where("x between xmin and xmax and y between ymin and ymax").select("box_id", "id")
