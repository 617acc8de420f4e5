"""Operator 3: quality classifier by importance resampling.

Two generative models of hashed word unigrams and bigrams (``BUCKETS`` buckets
each): one of target texts, one of all texts. A bucket's log ratio is shrunk by
its evidence: ``PRIOR`` counts of the raw model's expectation are added to the
target's, the ratio comes ``DRIFT`` nearer to 0, which a language's share in the
target alone can move it by, and is taken in the share e / (e + EVIDENCE) for e
expected counts, so n-grams that a target of this size can hardly hold say
little. A document's log weight is the sum over its n-grams times the root of ``LENGTH``
by their number: the noise of that sum grows with the root, so long texts are
not decided by it. The rows with the largest weight plus Gumbel noise are kept,
which draws without replacement in proportion to the weights.

Target texts are documents labelled good and not toxic, at most ``max_labels``
labelled rows, chosen by a hash of the id (that many ids are broadcast: 16 MB
at most). Half of them, by another hash, make the target model. All documents
are counted for the raw model, all are scored. How many are kept is a
parameter; by default as many as reach the value that a share ``keep_good`` of
the other half, which the model has not seen, reaches.

For a given k the k-th largest value is found by counts of ever narrower bins,
no more than ``BINS`` of which reach the driver at a time.

Noise is a function of the id and the text, so reruns agree and equal rows are
equal; rows that tie with the k-th are kept as well. Nulls and texts without
words have weight 0. Without labels all rows are kept. Null ids are never
labelled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .textnp import LOWER, SPACE, chunks, mix, span_hash, spans

BITS = 18
BUCKETS = 1 << BITS
#: Chosen on five random halves of the labels of sf0.1; the README has figures on the half that the model has not seen.
PRIOR, EVIDENCE, DRIFT, LENGTH = 3.0, 5.0, 0.5, 1024
BINS = 1024


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and word pairs of a chunk, and the documents they are of."""
    data = LOWER[data]
    starts, ends, doc = spans(~SPACE[data], offsets)
    # words are told apart without the marks at their end
    while len(ends):
        mark = np.isin(data[ends - 1], np.frombuffer(b".,;:!?", np.uint8)) & (ends - starts > 1)
        if not mark.any():
            break
        ends = ends - mark
    words = span_hash(data, starts, ends)
    pair = mix(words[:-1] * np.uint64(0xD1342543DE82EF95) + words[1:])
    same = doc[1:] == doc[:-1]
    keys = np.concatenate((words, pair[same]))
    return (keys >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate((doc, doc[:-1][same]))


def log_ratios(docs: DataFrame, good: DataFrame) -> np.ndarray:
    """Log ratio of target and raw probability by bucket. ``good(doc_id)`` is small and unique."""

    def run(batches):
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            marked = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for i, data, offsets in chunks(batch.column(0)):
                keys, doc = features(data, offsets)
                raw += np.bincount(keys, minlength=BUCKETS)
                target += np.bincount(keys[marked[i:][doc]], minlength=BUCKETS)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"])

    marked = docs.join(F.broadcast(good.withColumn("__good", F.lit(True))), "doc_id", "left").select("text", F.coalesce("__good", F.lit(False)).alias("good"))
    sums = marked.mapInArrow(run, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)  # a row for each bucket at most
    raw[sums["bucket"].to_numpy()], target[sums["bucket"].to_numpy()] = sums["raw"].to_numpy(), sums["target"].to_numpy()
    return shrunk(raw, target)


def shrunk(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log ratios of target and raw model by bucket, each in the measure of its evidence."""
    if not target.sum():
        return np.zeros(len(raw))
    expected = raw * (target.sum() / raw.sum())
    ratio = np.log((target + PRIOR) / (expected + PRIOR))
    return np.sign(ratio) * np.maximum(np.abs(ratio) - DRIFT, 0.0) * expected / (expected + EVIDENCE)


def weights(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """(doc_id, log_weight, n_features, h): h is a hash of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def run(batches):
        for batch in batches:
            for i, data, offsets in chunks(batch.column(2)):
                keys, doc = features(data, offsets)
                n = len(offsets) - 1
                count = np.bincount(doc, minlength=n)
                sums = np.bincount(doc, shared.value[keys], minlength=n) * np.sqrt(LENGTH / np.maximum(count, 1))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), batch.column(1).slice(i, n), pa.array(np.round(sums, 6)), pa.array(count)], ["doc_id", "h", "log_weight", "n_features"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("h"), "text").mapInArrow(run, f"doc_id {kind}, h long, log_weight double, n_features long")


def kth_largest(values: DataFrame, k: int) -> float | None:
    """The k-th largest of ``values(value)``, null if there are fewer: bins are narrowed around it until few values are in one."""
    low, high, rows = values.agg(F.min("value"), F.max("value"), F.count("value")).first()
    if k > rows or k < 1:
        return None
    inside, left = values, k
    while rows > 10_000 and high > low:
        width = (high - low) / BINS
        bins = inside.groupBy(F.least(F.floor((F.col("value") - low) / width), F.lit(BINS - 1)).alias("bin")).agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
        for r in sorted(bins.collect(), key=lambda r: -r.bin):
            if r.n >= left:
                low, high, rows = r.low, r.high, r.n
                break
            left -= r.n
        inside = values.where(F.col("value").between(low, high))
    if high == low:
        return low
    return inside.orderBy(F.desc("value")).limit(left).agg(F.min("value")).first()[0]


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, keep_good: float = 0.99, max_labels: int = 1_000_000, seed: int = 1) -> DataFrame:
    """(doc_id, log_weight, kept) of ``docs(doc_id, text)`` given ``labels(doc_id, quality, toxic)``."""
    some = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min((F.col("quality") == 1) & ~F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("good"))
    some = written(some.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(max_labels), "labels")
    good = some.where("good").select("doc_id", (F.xxhash64(F.lit(seed), F.lit(2), "doc_id") % 2 == 0).alias("fit"))
    scores = weights(docs, log_ratios(docs, good.where("fit").select("doc_id")))
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "h"), 11) + 0.5) / float(1 << 53)
    scores = written(scores.withColumn("value", F.col("log_weight") - F.log(-F.log(uniform))), "weights")
    if k is None:  # as many as reach the cut: that the k-th value is the least of them needs no search
        cut = scores.join(F.broadcast(good.where("not fit")), "doc_id", "left_semi").agg(F.percentile("value", 1 - keep_good)).first()[0]  # at most max_labels values
    else:
        cut = kth_largest(scores.select("value"), k) if k > 0 else float("inf")
    return scores.select("doc_id", "log_weight", (F.lit(True) if cut is None else F.col("value") >= cut).alias("kept"))
