"""Operator 8: line dedup by overlapping three-line windows, with DataFrame and SQL functions only.

Lines are split at ``\\n``. Every three consecutive lines with a word in any of
them form a window. Of each window's occurrences (by doc_id, then text, then
line) the first stays; the lines that any later one covers are removed. What
is left is joined again by ``\\n``.

Windows are hashed to 160 bits where they lie and only hash and place are
shuffled. The first place of each repeated hash comes from a partial
aggregation, so a window in a third of all rows is combined before the
shuffle; the join back to the places is an equi-join that adaptive execution
splits where it is hot.

Documents with fewer than three lines, null and empty texts stay as they are.
Rows equal in doc_id and text are one document in the comparison and share its
result; null ids come first. Columns are those of the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 3


def removed_lines(docs: DataFrame) -> DataFrame:
    """(__id, __h1, __h2, __gone): for each document that loses lines, the sorted distinct positions of those lines."""
    base = docs.where("text is not null").select(F.col("doc_id").alias("__id"), *_key(docs), F.split("text", "\n").alias("lines")).where(F.size("lines") >= SIZE)
    at = F.sequence(F.lit(0), F.size("lines") - SIZE)
    window = lambda i: [F.get("lines", i + k) for k in range(SIZE)]
    places = base.select("__id", "__h1", "__h2", F.explode(F.transform(at, lambda i: F.struct(
        i.alias("at"), F.xxhash64(*window(i)).alias("a"), F.xxhash64(F.lit(7), *window(i)).alias("b"), F.hash(*window(i)).alias("c"),
        F.concat_ws("", *window(i)).rlike(r"[^\x20\x09-\x0D]").alias("words")))).alias("w")).where("w.words").select("__id", "__h1", "__h2", "w.at", "w.a", "w.b", "w.c")
    place = F.struct("__id", "__h1", "__h2", "at")
    firsts = places.groupBy("a", "b", "c").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last")
    later = places.join(firsts.select("a", "b", "c", "first"), ["a", "b", "c"]).where(~place.eqNullSafe(F.col("first")))
    return later.groupBy("__id", "__h1", "__h2").agg(F.collect_set("at").alias("ats")).select(
        "__id", "__h1", "__h2", F.array_distinct(F.flatten(F.transform("ats", lambda i: F.sequence(i, i + SIZE - 1)))).alias("__gone"))


def _key(docs: DataFrame):
    return F.xxhash64("text").alias("__h1"), F.xxhash64(F.lit(1), F.col("text")).alias("__h2")


def dedup_lines(docs: DataFrame, counts: bool = False) -> DataFrame:
    """``docs`` without repeated lines; with ``counts`` also n_lines and n_removed."""
    gone = removed_lines(docs)
    left = docs.withColumns({"__k1": F.xxhash64("text"), "__k2": F.xxhash64(F.lit(1), F.col("text"))})
    same = left["doc_id"].eqNullSafe(gone["__id"]) & (left["__k1"] == gone["__h1"]) & (left["__k2"] == gone["__h2"])
    out = left.join(gone, same, "left")
    lines = F.split("text", "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "__gone")
    kept = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    # a column of its own: inside a lambda a name means the alias of the same select before the column
    out = out.withColumn("__kept", F.when(F.col("__gone").isNotNull(), kept))
    new = {"text": F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.col("__kept"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("__gone").isNull(), F.col("n_chars")).otherwise(F.length("__kept")).cast(docs.schema["n_chars"].dataType)
    if counts:
        new |= {"n_lines": F.coalesce(F.size(lines), F.lit(0)).cast("long"), "n_removed": F.coalesce(F.size("__gone"), F.lit(0)).cast("long")}
    extra = [c for c in ("n_lines", "n_removed") if counts and c not in docs.columns]
    return out.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns], *[new[c].alias(c) for c in extra])
