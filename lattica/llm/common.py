"""Shared pieces: tables, the shared folder, written intermediate tables and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where none is named a temporary folder is made once and set for the session, on one machine (master ``local``) only.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lattica-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lattica/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage, survives lost executors, keeps sizes for the planner."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lattica_path = path
    return out


def drop_written(df: DataFrame) -> None:
    """Delete what ``written`` wrote; only for tables that nothing reads any more."""
    if path := getattr(df, "_lattica_path", None):
        drop_path(df.sparkSession, path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder in the shared one."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def placed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__file`` and ``__at``, the Parquet file and the place in it of each row, the same in every scan; written first if it is no such scan."""

    def marked(df):
        return df.withColumns({"__file": F.col("_metadata.file_path"), "__at": F.col("_metadata.row_index")})

    try:
        return marked(docs)
    except AnalysisException:
        return marked(written(docs, "docs"))


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__row``, a number of each row that is the same in every scan (a small table numbers the files)."""
    rows = placed(docs)
    # names of files, which the driver holds as well: up to 2**31 of them with 2**32 rows each
    files = written(rows.select("__file").distinct().coalesce(1).withColumn("__n", F.monotonically_increasing_id()), "files")
    return rows.join(files, "__file").withColumn("__row", F.col("__n") * F.lit(1 << 32) + F.col("__at")).drop("__file", "__at", "__n")


def hash128(*cols: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of the same columns; together they tell rows apart at any size met in practice."""
    return F.xxhash64(*cols), F.xxhash64(F.lit(0x5BD1E995), *cols)


def maybe_flag(df: DataFrame, key: Column, members: DataFrame, member: Column, words: int = 17) -> DataFrame:
    """``df`` with ``__maybe``: true for every row whose key is among ``members``, and by chance for some others.

    A bitmap of 2**(words+6) hashes, as at most 2**words rows, is broadcast: its size is fixed whatever the tables hold.
    It spares a following join most of the shuffle of rows that would not match; with far more members than bits it
    lets everything pass, and the join does all of the work.
    """
    h = F.xxhash64(member)
    bits = members.select(F.shiftrightunsigned(h, 64 - words).alias("__w"), F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int")).alias("b")).groupBy("__w").agg(F.bit_or("b").alias("__b"))
    h = F.xxhash64(key)
    marked = df.withColumn("__h", h).withColumn("__w", F.shiftrightunsigned(F.col("__h"), 64 - words)).join(F.broadcast(bits), "__w", "left")
    hit = F.call_function("shiftrightunsigned", F.col("__b"), F.col("__h").bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1
    return marked.withColumn("__maybe", F.coalesce(hit, F.lit(False))).select(*[F.col(f"`{c}`") for c in df.columns], "__maybe")


def maybe_in(df: DataFrame, key: Column, members: DataFrame, member: Column, words: int = 17) -> DataFrame:
    """The rows of ``df`` that ``maybe_flag`` marks: none of the members' is missed, some others pass."""
    return maybe_flag(df, key, members, member, words).where("__maybe").drop("__maybe")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of the undirected ``edges(a, b)``: ``(node, component)`` with the smallest node as component.

    Alternating large-star and small-star rounds: each round is an aggregation
    and an equi-join on the node (which adaptive execution splits when a hub is
    hot), so no neighbour list is ever collected. Every round is written to the
    shared folder. Nodes without edges are absent. Null nodes are ignored.
    """
    now = written(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("u is not null and v is not null and u > v").distinct(), "edges")

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = both.join(least, "u")
        if large:  # every larger neighbour of u is tied to the least node around u
            out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:  # u and its smaller neighbours are tied to the least of them
            out = joined.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        return out.where("u <> v").distinct()

    def mark(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = mark(now)
    for _ in range(max_rounds):
        new = written(star(star(now, True), False), "edges")
        drop_written(now)
        now, after = new, mark(new)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
