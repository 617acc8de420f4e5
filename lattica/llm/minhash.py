"""Operator 9: MinHash near-dedup by one-permutation hashing with optimal densification.

A document's set of distinct five-word shingles (ASCII lower case) is hashed
once; the hash's high bits name one of ``K`` (bands times ``ROWS``) bins, whose least value is kept.
Empty bins are filled from full ones that a fixed hash of (bin, attempt)
picks. The bands of bins are bucket keys.

Documents with the same set are one class first, so thousands of copies are
one row from then on. In a bucket only star-shaped edges are candidates: from
its hub, the class that meets most others over all bands, to each other one, so
a bucket of m classes gives m-1 edges.
Every edge is confirmed on the full sets. In buckets whose classes are not all
connected by then, classes of different components are candidates as well if
what they have differently from the hub, of the full sets, allows a link (see
``open_pairs``). So no link between components that meet in a bucket is lost, while buckets of one
component, which is what large groups of copies are, cost one edge a class.

With 25 bands of 5 bins a pair at the threshold of 0.85 shares no bucket with
probability 1e-6 and one at 0.9 with 1e-10. Below 0.85 there are as many bands
as miss a pair at the threshold with that probability: 35 at 0.8.

Nulls and texts without words have the empty set and link with nothing; fewer
than five words are one shingle. Rows with the same doc_id are the same node;
a null doc_id is a node of its own that links with nothing (component null).
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import components, maybe_in, numbered, written
from .textnp import LOWER, SPACE, chunks, mix, span_hash, spans, windows_hash

WORDS = 5
BANDS, ROWS = 25, 5
MISS = 1e-6


def bands_for(percent: int) -> int:
    """Bands of which a pair at the threshold shares none with probability MISS at most; BANDS at least."""
    return max(BANDS, math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** ROWS)) if percent < 85 else BANDS)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document of a chunk, one after the other, and their offsets."""
    data = LOWER[data]
    starts, ends, doc = spans(~SPACE[data], offsets)
    words = span_hash(data, starts, ends)
    n = len(offsets) - 1
    hashes, at = windows_hash(words, doc, size)
    docs = doc[at]
    count = np.bincount(doc, minlength=n)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        first = np.searchsorted(doc, short)
        h = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            has = count[short] > k
            h[has] = h[has] * np.uint64(0xD1342543DE82EF95) + words[first[has] + k]
        hashes = np.concatenate((hashes, mix(h + count[short].astype(np.uint64))))
        docs = np.concatenate((docs, short))
    order = np.lexsort((hashes, docs))
    hashes, docs = hashes[order], docs[order]
    if len(hashes):
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])
        hashes, docs = hashes[new], docs[new]
    return hashes, np.searchsorted(docs, np.arange(n + 1))


@functools.cache
def _donors(k: int) -> np.ndarray:
    """For each attempt the bin among ``k`` that each bin is filled from."""
    found = mix(np.arange(k, dtype=np.uint64)[None, :] * np.uint64(1 << 32) + np.arange(1, 4097, dtype=np.uint64)[:, None]) % np.uint64(k)
    return found.astype(np.int64)


def signatures(hashes: np.ndarray, offsets: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One-permutation signatures (documents x bands * ROWS) of non-empty sets, densified."""
    n, k_bins = len(offsets) - 1, bands * ROWS
    donors = _donors(k_bins)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    bins = ((hashes >> np.uint64(32)) * np.uint64(k_bins)) >> np.uint64(32)
    key = doc * k_bins + bins.astype(np.int64)
    sig = np.full(n * k_bins, np.uint64(2**64 - 1))
    order = np.argsort(key, kind="stable")
    if len(order):
        k = key[order]
        first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        sig[k[first]] = np.minimum.reduceat(mix(hashes[order]), first)
    sig = sig.reshape(n, k_bins)
    full = sig != np.uint64(2**64 - 1)
    hole = ~full & full.any(1)[:, None]
    out = sig.copy()
    for attempt in range(len(donors)):
        r, c = np.nonzero(hole)
        if not len(r):
            return out
        d = donors[attempt][c]
        ok = full[r, d]
        out[r[ok], c[ok]] = sig[r[ok], d[ok]]
        hole[r[ok], c[ok]] = False
    r, c = np.nonzero(hole)  # after so many attempts the least full bin stands in
    out[r, c] = sig[r, full[r].argmax(1)]
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """Bucket keys (documents x bands)."""
    bands = sig.shape[1] // ROWS
    out = np.zeros((len(sig), bands), np.uint64)
    for i in range(ROWS):
        out = out * np.uint64(0xD1342543DE82EF95) + sig[:, i::ROWS][:, :bands]
    return mix(out + np.arange(bands, dtype=np.uint64))


def sets_of(docs: DataFrame, bands: int = BANDS) -> DataFrame:
    """(doc_id, n, s1, s2, keys): size and 128-bit digest of the set and its bucket keys."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for i, data, offsets in chunks(batch.column(1)):
                hashes, at = shingle_sets(data, offsets)
                n = np.diff(at)
                keys = band_keys(signatures(hashes, at, bands)).view(np.int64)
                sums = [np.concatenate(([np.uint64(0)], np.cumsum(mix(hashes + np.uint64(k))))) for k in (1, 2)]
                s1, s2 = (mix(s[at[1:]] - s[at[:-1]]).view(np.int64) for s in sums)
                lists = pa.ListArray.from_arrays(pa.array((np.arange(len(n) + 1) * bands).astype(np.int32)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([ids.slice(i, len(n)), pa.array(n), pa.array(s1), pa.array(s2), lists], ["doc_id", "n", "s1", "s2", "keys"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, s1 long, s2 long, keys array<long>")


def _sets(texts) -> tuple[np.ndarray, np.ndarray]:
    """Sets of a column of texts, one after the other, and their offsets."""
    parts, sizes = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for _, data, offsets in chunks(texts):
        hashes, at = shingle_sets(data, offsets)
        parts.append(hashes)
        sizes.append(np.diff(at))
    return np.concatenate(parts), np.cumsum(np.concatenate(sizes))


def similarity(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """``pairs(a, b)`` with ``inter`` and ``both``: sizes of intersection and union of the full sets of ``docs(node, text)``.

    Texts are shuffled, not sets: they compress to less. Those in no pair are left out before.
    """

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                (x, ax), (y, ay) = _sets(part.column(2)), _sets(part.column(3))
                inter = np.zeros(part.num_rows, np.int64)
                for i in range(part.num_rows):
                    short, long = x[ax[i] : ax[i + 1]], y[ay[i] : ay[i + 1]]
                    if len(short) > len(long):
                        short, long = long, short
                    if len(short):
                        at = np.searchsorted(long, short)
                        at[at == len(long)] = 0
                        inter[i] = (long[at] == short).sum()
                both = np.diff(ax) + np.diff(ay) - inter
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(inter), pa.array(both)], ["a", "b", "inter", "both"])

    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    texts = maybe_in(docs, F.col("node"), nodes, F.col("node"))
    one = pairs.select("a", "b").join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    two = one.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
    return two.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, inter long, both long")


def differences(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(hub, node, shingle): shingles that only one of both has, of the full sets."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                (x, ax), (y, ay) = _sets(part.column(2)), _sets(part.column(3))
                found = [np.setxor1d(x[ax[i] : ax[i + 1]], y[ay[i] : ay[i + 1]], assume_unique=True) for i in range(part.num_rows)]
                sizes = np.array([len(f) for f in found], np.int64)
                ids = [np.repeat(part.column(i).to_numpy(), sizes) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, ids), pa.array(np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64))], ["hub", "node", "shingle"])

    nodes = pairs.select(F.explode(F.array("hub", "node")).alias("node"))
    texts = maybe_in(docs, F.col("node"), nodes, F.col("node"))
    one = pairs.select("hub", "node").join(texts.select("node", F.col("text").alias("y")), "node")
    two = one.join(texts.select(F.col("node").alias("hub"), F.col("text").alias("x")), "hub")
    return two.select("hub", "node", "x", "y").mapInArrow(run, "hub long, node long, shingle long")


def open_pairs(rest: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of ``rest(hub, node, size, hub_size, c, hub_c)`` with one hub and different components that may be linked; none that is linked is missing.

    Two sets of together s shingles are linked if they differ in at most s * k, k = (1 - J) / (1 + J). With n being the
    number of shingles that a set has differently from the hub and w = n - size * k, a pair must share at least
    (w1 + w2) / 2 of those differences, at least one as a class outside of the hub's component is that far from it. So
    of both lists of differences, rarest first, heads must meet (a prefix filter). Each list is cut to its head before
    the join: of the one with the smaller w the head that any pair with a larger w leaves it, n - w + 1, which shingles
    that most of a family has never reach; of the other what the smallest w in reach leaves it. So in a group of copies
    that were changed each in its own way no keys meet, and a shingle of the whole family is no key at all.
    """
    diff = differences(rest, docs)
    # written: the plan of the differences is a large one, and not to be twice in the next
    often = written(diff.groupBy("hub", "shingle").agg(F.count("*").alias("often")).where("often > 1"), "often")
    mine = Window.partitionBy("hub", "node")
    listed = diff.join(often, ["hub", "shingle"], "left").withColumn("often", F.coalesce("often", F.lit(1)))
    listed = listed.withColumns({"rank": F.row_number().over(mine.orderBy("often", "shingle")), "n": F.count("*").over(mine)}).where("often > 1")
    # w in units of 1 / (100 + percent), so that all is integer
    own = rest.select("hub", "node", "size", "hub_size", "c", "hub_c")
    listed = listed.join(own, ["hub", "node"]).withColumn("w", F.col("n") * (100 + percent) - F.col("size") * (100 - percent))
    # a partner is in the hub's component, and then no nearer to it than by what both sizes differ, or outside and w above hub_size * k
    least = F.when(F.col("c") == F.col("hub_c"), F.col("hub_size") * (100 - percent)).otherwise(-F.floor(F.col("size") * 100 / percent) * (100 - percent))
    ceil = lambda x, unit: F.ceil(x / F.lit(float(unit)) - 1e-9)
    listed = listed.withColumns({
        "low": F.col("n") - F.greatest(ceil(F.col("w"), 100 + percent), F.lit(1).cast("long")) + 1,
        "high": F.col("n") - F.greatest(ceil(F.col("w") + least, 2 * (100 + percent)), F.lit(1).cast("long")) + 1})
    listed = written(listed.where(F.col("rank") <= F.greatest("low", "high")).select("hub", "shingle", "node", "rank", "n", "size", "c", "w", "low", "high"), "differences")
    x = listed.where("rank <= low").select("hub", "shingle", *[F.col(k).alias(k + "1") for k in ("node", "rank", "n", "size", "c", "w")])
    y = listed.where("rank <= high").select("hub", "shingle", *[F.col(k).alias(k + "2") for k in ("node", "rank", "n", "size", "c", "w")])
    need = F.greatest(ceil(F.col("w1") + F.col("w2"), 2 * (100 + percent)), F.lit(1).cast("long"))
    close = F.least("size1", "size2") * 100 >= F.greatest("size1", "size2") * percent
    heads = (F.col("rank1") <= F.col("n1") - need + 1) & (F.col("rank2") <= F.col("n2") - need + 1)
    ordered = (F.col("w1") < F.col("w2")) | ((F.col("w1") == F.col("w2")) & (F.col("node1") < F.col("node2")))
    met = x.join(y, ["hub", "shingle"]).where(ordered & (F.col("c1") != F.col("c2")) & close & heads)
    return met.select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of ``docs(doc_id, text)``."""
    found = written(sets_of(docs, bands_for(percent)), "sets")
    full = found.where("n > 0 and doc_id is not null")
    # classes of equal sets: hub copies are combined before the shuffle
    classes = written(full.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("node"), F.first("keys").alias("keys")), "classes")
    member = classes.select(F.col("n").alias("size"), "node", F.posexplode("keys").alias("band", "bucket"))
    sizes = member.groupBy("band", "bucket").agg(F.count("*").alias("m")).where("m > 1")
    shared = written(member.join(sizes, ["band", "bucket"]), "shared")
    # the hub of a bucket is its class that meets most others in all bands: the text that a group's copies are near to
    fame = shared.groupBy("node").agg(F.sum("m").alias("fame"))
    ranked = shared.join(fame, "node")
    hubs = ranked.groupBy("band", "bucket").agg(F.max_by("node", F.struct("fame", -F.col("node"))).alias("hub"))
    stars = written(shared.join(hubs, ["band", "bucket"]).select("band", "bucket", "hub", "node", "size"), "stars")
    pairs = written(stars.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    # rows that share an id share the node: one of their texts, the same in every run, stands for it
    reps = docs.select(F.col("doc_id").cast("long").alias("node"), "text")
    if not reps.groupBy("node").count().where("count > 1").isEmpty():
        reps = reps.where("node is not null").groupBy("node").agg(F.min("text").alias("text"))
    known = written(similarity(pairs, reps).withColumn("link", F.col("inter") * 100 >= F.col("both") * percent), "known")
    edges = written(known.where("link").select("a", "b"), "links")
    comp = written(components(edges), "components")
    label = stars.join(comp.withColumnRenamed("node", "n_"), F.col("node") == F.col("n_"), "left").select(
        "band", "bucket", "hub", "node", "size", F.coalesce("component", "node").alias("c"))
    mixed = label.groupBy("band", "bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("m")).where("lo < hi and m > 2")
    centre = label.where("node = hub").select("band", "bucket", F.col("size").alias("hub_size"), F.col("c").alias("hub_c"))
    rest = label.join(mixed.select("band", "bucket"), ["band", "bucket"]).where("node <> hub").join(centre, ["band", "bucket"])
    rest = rest.select("hub", "node", "size", "hub_size", "c", "hub_c").distinct()
    more = written(open_pairs(written(rest, "rest"), reps, percent).join(known.select("a", "b"), ["a", "b"], "left_anti"), "open")
    more = similarity(more, reps).where(F.col("inter") * 100 >= F.col("both") * percent).select("a", "b")
    more = written(more, "more")
    if not more.isEmpty():
        comp = written(components(edges.unionByName(more)), "components")
    joined = found.join(classes.select("n", "s1", "s2", "node"), ["n", "s1", "s2"], "left").join(comp.withColumnRenamed("component", "__c"), "node", "left")
    component = F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.coalesce("__c", "node", "doc_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def keep_first(docs: DataFrame, percent: int = 85) -> DataFrame:
    """``docs`` with one document of each group of near copies, the one with the smallest id, and all that are in none.

    Every row is a document of its own here, whatever its id: of rows with one id and unlike texts each is judged by its
    text, of equal rows one stays, and a null id comes after all others.
    """
    rows = numbered(docs)
    found = near_duplicates(rows.select(F.col("__row").alias("doc_id"), "text"), percent).select(F.col("doc_id").alias("__row"), "component_id")
    group = found.join(rows.select("__row", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "__row").alias("place")), "__row")
    group = written(group.select("__row", "component_id", "place"), "groups")
    several = group.groupBy("component_id").agg(F.min("place").getField("__row").alias("first"), F.count("*").alias("m")).where("m > 1")
    gone = group.join(several, "component_id").where("__row <> first").select("__row")
    return rows.join(gone, "__row", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
