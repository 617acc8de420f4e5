"""Operator 2: mixing sources to target weights, with DataFrame and SQL functions only.

The words of each source are packed into blocks of a fixed length. An output
shard has a fixed number of slots; its counts by source are drawn, slots are
numbered through per-source pseudorandom permutations of block indexes (one
for each pass over the source), and blocks are joined by index.

Plain multinomial counts stray from the target by the root of the count. So
the whole part of each expected count is fixed and only the remaining slots of
a shard are drawn from the multinomial of the fractional parts.

Skew: rows of a source are dealt into hash buckets of about ``BUCKET`` rows,
and every running sum goes over buckets, then over groups of buckets, so a
source with a third of all rows is never in one task. Sources may be as many as
hosts: they are a table, numbered by a distributed sort; targets come from
rounds of sums over it, and drawn slots find their source by a join on cells of
the cumulative weights. The driver holds sums only. Tables of buckets, shards
and blocks are written on the way: each is read more than once, and one plan of
all of it takes the driver's memory each time it is planned anew.

Nulls: a null source is a source (the last); a null or empty text has size 0,
is packed nowhere and is taken 0 times; a null id is kept. Repeated rows are
rows of their own; which of rows equal in id, source and text is taken more
often is of no consequence. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, numbered, written

#: Rows of a bucket, and buckets (or shards) of a group in running sums.
BUCKET = 1000
GROUP = 512
ROUNDS = 16


def running(df: DataFrame, by: str, index: str, value: str, out: str) -> DataFrame:
    """``out``: the sum of ``value`` over smaller ``index`` of the same ``by``, in two levels of windows."""
    group = F.floor(F.col(index) / GROUP)
    inner = Window.partitionBy(by, "__g").orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(by).orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__g", group)
    groups = df.groupBy(by, "__g").agg(F.sum(value).alias("__t")).select(by, "__g", F.coalesce(F.sum("__t").over(outer), F.lit(0)).alias("__before"))
    return df.join(groups, [by, "__g"]).withColumn(out, F.coalesce(F.sum(value).over(inner), F.lit(0)) + F.col("__before")).drop("__g", "__before")


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """A pseudorandom permutation of 0..n-1 for any n: swap-or-not rounds. ``key`` names the permutation."""

    def swap(v, i):
        partner = F.pmod(F.pmod(F.xxhash64(*key, i), n) - v, n)
        return F.when(F.xxhash64(*key, i, F.greatest(v, partner)).bitwiseAND(F.lit(1)) == 1, partner).otherwise(v)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x, swap)


def unit(*key: Column) -> Column:
    """A pseudorandom number in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*key), 11) / F.lit(float(1 << 53))


def capped(sources: DataFrame, cap: int) -> DataFrame:
    """``sources(size, weight)`` with ``target``: the total shared by weight, none above ``cap`` times its size, the excess shared again by weight.

    Each round puts the sources that their share exceeds at their cap and shares the rest again; it ends when no more do.
    """
    size, weight = F.col("source_size"), F.col("weight")
    first = sources.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.sum(weight), F.lit(0))).first()
    left, rest, known = first[0], first[1], 0
    above = F.lit(False)
    while rest:
        above = size * F.lit(float(cap)) * F.lit(float(rest)) < F.lit(float(left)) * weight
        n, full, heavy = sources.agg(F.count_if(above), F.coalesce(F.sum(F.when(above, size)), F.lit(0)), F.coalesce(F.sum(F.when(above, weight)), F.lit(0))).first()
        if n == known:
            break
        left, rest, known = first[0] - cap * full, first[1] - heavy, n
    share = F.lit(float(left)) * weight / F.lit(float(rest)) if rest else F.lit(0.0)
    return sources.withColumn("target", F.when(above, size * F.lit(float(cap))).otherwise(share))


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``src``, the place of each row in the order, from a distributed sort and a row count for each of its partitions."""
    rows = written(df.orderBy(*order).withColumn("__m", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__m", 33)
    counts = rows.groupBy(part.alias("__p")).agg(F.count("*").alias("n"))
    before = counts.select("__p", F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    place = F.col("__b") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn("__p", part).join(before, "__p").withColumn("src", place).drop("__p", "__b", "__m")


class Mix:
    """Plan of a mix over ``docs``: ``rows`` (numbered), ``sized`` (their size and source), ``sources`` and ``expected`` blocks."""

    def __init__(self, docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text",
                 weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, block: int = 128, slots: int = 4096, seed: int = 1):
        self.block, self.cap, self.slots, self.seed = block, cap, slots, seed
        self.rows = numbered(docs)
        size = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")
        rows = written(self.rows.select("__row", F.col(doc_id).alias("__id"), F.col(source).alias("__source"), size.alias("size"), F.xxhash64(text).alias("__text")), "sized")
        buckets = -(-max(rows.count(), 1) // BUCKET)
        rows = rows.withColumn("b", F.pmod(F.xxhash64("__id", "__text"), F.lit(buckets)))
        # one row for each source from here on; strings are ordered by their bytes, which is by code point
        found = ranked(rows.groupBy("__source").agg(F.sum("size").alias("source_size")), F.col("__source").asc_nulls_last())
        weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("src") % len(weights) + 1).cast("int"))
        self.sources = written(capped(written(found.withColumn("weight", weight.cast("long")), "weighed"), cap), "sources")
        self.sized = rows.join(self.sources.withColumnRenamed("__source", "__s"), F.col("__source").eqNullSafe(F.col("__s"))).drop("__s")
        packed = self.sized.where("size > 0")
        place = Window.partitionBy("src", "b").orderBy("__id", "size", "__text", "__row")
        self.placed = packed.withColumn("start", F.sum("size").over(place) - F.col("size"))
        stock = written(packed.groupBy("src", "b").agg(F.ceil(F.sum("size") / block).alias("n")), "stock")
        self.offsets = written(running(stock, "src", "b", "n", "first").select("src", "b", "first"), "offsets")
        blocks = stock.groupBy("src").agg(F.sum("n").alias("blocks"))
        self.expected = written(blocks.join(self.sources, "src").select("src", "blocks", (F.col("target") * F.col("blocks") / F.col("source_size")).alias("q")), "expected")

    def used(self, spark: SparkSession) -> DataFrame:
        """(src, block, copies): how often the output shards take each block."""
        total = self.expected.agg(F.sum("q")).first()[0] or 0.0
        if not total:
            return self.expected.select("src", F.col("blocks").alias("block"), F.col("blocks").alias("copies")).where("false")
        n = max(1, -(-round(total) // self.slots))
        last = round(total) - (n - 1) * self.slots
        # for a full shard and the last one: the whole part of each source's share, and its fraction as an integer
        share = F.explode(F.array(*[F.struct(F.lit(tail).alias("tail"), (F.col("q") * float(size) / total).alias("share")) for tail, size in ((False, self.slots), (True, last))])).alias("s")
        parts = self.expected.select("src", share).select("src", "s.tail", F.floor("s.share").alias("whole"), F.round((F.col("s.share") - F.floor("s.share")) * float(1 << 40)).cast("long").alias("part"))
        parts = written(running(parts, "tail", "src", "part", "before"), "parts")
        sums = {r[0]: (r[1], r[2], r[3]) for r in parts.groupBy("tail").agg(F.sum("whole"), F.sum("part"), F.count_if(F.col("part") > 0)).collect()}
        shards = spark.range(n).select(F.col("id").alias("shard"), (F.col("id") == n - 1).alias("tail"))
        # whole parts of a shard sum up to its slots at most, so that many rows are broadcast
        counts = shards.join(F.broadcast(parts.where("whole > 0").select("tail", "src", "whole")), "tail").select("shard", "src", F.col("whole").alias("n"))
        for tail, size in ((False, self.slots), (True, last)):
            whole, weight, several = sums[tail]
            left = max(0, size - whole)
            if not left or not weight:
                continue
            width = max(1, -(-weight // (1 << several.bit_length())))
            cells = parts.where((F.col("tail") == tail) & (F.col("part") > 0)).select("src", "before", "part", F.explode(F.sequence(F.floor(F.col("before") / F.lit(width)), F.floor((F.col("before") + F.col("part") - 1) / F.lit(width)))).alias("cell"))
            draws = shards.where(F.col("tail") == tail).select("shard", F.explode(F.sequence(F.lit(1), F.lit(left))).alias("t"))
            draws = draws.select("shard", F.floor(unit(F.lit(self.seed), F.col("shard"), F.col("t")) * F.lit(float(weight))).alias("at")).withColumn("cell", F.floor(F.col("at") / F.lit(width)))
            counts = counts.unionByName(draws.join(cells, "cell").where("at >= before and at < before + part").select("shard", "src", F.lit(1).cast("long").alias("n")))
        counts = running(written(counts.groupBy("src", "shard").agg(F.sum("n").alias("n")), "counts"), "src", "shard", "n", "k0")
        # few rows that grow by the slots of a shard each: dealt to all tasks before they do
        counts = counts.where("n > 0").select("src", "shard", "n", "k0").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "src", "shard")
        slots = counts.join(self.expected.select("src", "blocks"), "src").select("src", "blocks", F.explode(F.sequence(F.col("k0"), F.col("k0") + F.col("n") - 1)).alias("k"))
        slots = slots.where(F.col("k") < self.cap * F.col("blocks"))  # never a block more often than the cap
        turn = F.floor(F.col("k") / F.col("blocks"))
        index = permuted(F.pmod("k", "blocks"), F.col("blocks"), F.lit(self.seed), F.col("src"), turn)
        return written(slots.select("src", index.alias("block")).groupBy("src", "block").agg(F.count("*").alias("copies")), "used")

    def pieces(self) -> DataFrame:
        """The parts of rows that lie in taken blocks: ``sized`` columns, ``at`` (first word), ``words`` and ``copies``."""
        b = F.lit(self.block)
        # both tables grow with the rows and take far less as files than in memory: never broadcast by the size of their files
        parts = self.placed.join(self.offsets.hint("merge"), ["src", "b"]).withColumn(
            "piece", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b))))
        begin = F.greatest(F.col("start"), F.col("piece") * b)
        end = F.least(F.col("start") + F.col("size"), (F.col("piece") + 1) * b)
        parts = parts.withColumns({"at": begin - F.col("start"), "words": end - begin, "block": F.col("first") + F.col("piece")})
        return parts.join(self.used(self.sized.sparkSession).hint("merge"), ["src", "block"])

    def taken(self) -> DataFrame:
        """A row for each row of ``docs``: doc_id, size, source_size, target, taken."""
        sums = self.pieces().groupBy("__row").agg(F.sum(F.col("words") * F.col("copies")).alias("taken"))
        return self.sized.join(sums, "__row", "left").select(F.col("__id").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, block: int = 2048, **kw) -> DataFrame:
    """The mixed corpus as documents: for each row and each copy number up to the cap, a row with the words that
    are taken at least so often, white space kept. Columns are those of ``docs``; ``n_chars`` is set where it is there.
    """
    mix = Mix(docs, block=block, **kw)
    parts = mix.pieces().select("__row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("__copy"), F.struct("at", "words").alias("part"))
    parts = parts.groupBy("__row", "__copy").agg(F.array_sort(F.collect_list("part")).alias("__parts"))
    chunks = F.regexp_extract_all(F.col("text"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+(?:[\x20\x09-\x0D]+$)?"), F.lit(0))
    joined = F.array_join(F.flatten(F.transform("__parts", lambda p: F.slice(F.col("__chunks"), (p["at"] + 1).cast("int"), p["words"].cast("int")))), "")
    out = mix.rows.join(parts, "__row").withColumn("__chunks", chunks).withColumn("text", joined)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
