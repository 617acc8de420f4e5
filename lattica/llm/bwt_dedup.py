"""Operator 10: suffix-array dedup by threshold-bounded interval expansion on a Burrows-Wheeler transform.

Every ``LENGTH``-byte string of a document has an anchor: the least hash of its
``GRAM``-byte grams, leftmost if equal. Equal strings have equal anchors at
equal offsets, so strings are only to be compared under one anchor. Successive
strings with the same anchor make a snippet (139 bytes on average). Only
hashes and places are shuffled: anchors met once are dropped by a partial
aggregation, equal snippets are one class with its first place. A class that is
alone under its anchor has nothing to be compared with.

An anchor with more than ``HOT`` bytes of classes, as one at the rim of a
passage that a third of all documents hold each in another context, is split:
its strings are dealt by where the anchor stands in them, in steps of 10 bytes
and then of one, and by the bytes beside it that all strings of a step have.
Equal strings stay together, each key has one step's strings and contexts only,
and at steps of one byte a key is one string. So no task ever gets more than
about ``HOT`` bytes of one key.

The other classes' bytes are gathered into texts of whole anchors, of about
``TEXT`` bytes. On the Burrows-Wheeler transform of a text, intervals are
extended backward breadth-first: level l derives all common prefixes of value
l. It stops at ``LENGTH``: suffixes without a value by then share that many
bytes with the one before them and form the groups of equal strings. All but
the first of a group are removed, as are all snippets equal to an earlier one.

Bytes that removed strings cover are merged per document; exactly they are cut.

Nulls are empty texts. Rows equal in doc_id and text are one document and
share its result; rows that share only the id are ordered by a hash of their
text; a null id comes first. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import maybe_flag, maybe_in, written
from .textnp import chunks, mix, ranges, span_hash

LENGTH, GRAM = 100, 16
TEXT = HOT = 1 << 20
#: Steps by which strings of a hot anchor are dealt, one after the other.
STEPS = (10, 1)
PLACES = ["doc", "th", "start", "len", "a", "s"]


def grams(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes at each byte but the last GRAM-1."""
    n = len(data) - GRAM + 1
    raw = np.ascontiguousarray(data)
    word = np.ndarray(n + 8, "<u8", raw, strides=(1,)) if n > 0 else np.zeros(0, np.uint64)
    if n <= 0:
        return np.zeros(0, np.uint64)
    return mix(word[:n] * np.uint64(0x9E3779B97F4A7C15) ^ mix(word[8 : n + 8] * np.uint64(1)))


def snippets(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(document, start in the chunk, length, anchor hash, place of the anchor) of every snippet of a chunk."""
    n, windows = len(data), len(data) - length + 1
    if windows <= 0:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64), z
    h = grams(data)
    least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    width, span = 1, length - GRAM + 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if span > width:
        least = np.minimum(least[: windows], least[span - width : span - width + windows])
    anchor = (least[:windows] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    valid = np.zeros(windows, bool)
    sizes = np.maximum(0, np.diff(offsets) - length + 1)
    valid[ranges(offsets[:-1], sizes)] = True
    new = np.ones(windows, bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    begin = np.flatnonzero(new & valid)
    last = np.ones(windows, bool)
    last[:-1] = (anchor[1:] != anchor[:-1]) | ~valid[1:]
    end = np.flatnonzero(last & valid)
    return np.searchsorted(offsets, begin, "right") - 1, begin, end - begin + length, h[anchor[begin]], anchor[begin]


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes ordered by their first ``depth`` bytes at least (doubling from 8-byte keys; only ties are sorted again)."""
    n = len(text)
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    key = np.ndarray(n, ">u8", padded, strides=(1,)).astype(np.uint64)
    order = np.argsort(key)
    key = key[order]
    head = np.concatenate(([True], key[1:] != key[:-1]))
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    h = 8
    while h < depth:
        tied = ~head
        tied[:-1] |= ~head[1:]
        slots = np.flatnonzero(tied)
        if not len(slots):
            break
        items = order[slots]
        key = (rank[items] << 32) | (rank[np.minimum(items + h, n)] + 1)
        by = np.argsort(key)
        key, items = key[by], items[by]
        order[slots] = items
        new = np.concatenate(([True], key[1:] != key[:-1]))
        head[slots] = new
        rank[items] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        h *= 2
    return order


def shared_prefixes(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix order, the empty suffix included, and first): ``first`` is true where a suffix shares fewer than ``length`` bytes with the one before it."""
    text = np.concatenate((text, np.full(length, 255, np.uint8)))  # no UTF-8 text has this byte: suffixes at the end differ
    order = np.concatenate(([len(text)], suffix_order(text, length + 1)))  # the empty suffix is the first
    n = len(order)
    before = np.where(order > 0, text[order - 1].astype(np.uint16) + 1, 0).astype(np.uint16)
    by = np.argsort(before, kind="stable")
    step = np.empty(n, np.int64)  # where the suffix one byte longer stands
    step[by] = np.arange(n)
    letter = np.concatenate(([True], before[by][1:] != before[by][:-1]))  # rows where the suffixes of a byte begin
    value = np.full(n + 1, -1, np.int16)
    value[n] = 0
    lo, hi, begin = np.array([0]), np.array([n - 1]), 0
    if length > 8:  # values below 8 are those of the 8-byte keys; the intervals of 8 bytes found by value 7 go on
        key = np.ndarray(n, ">u8", np.concatenate((text, np.zeros(8, np.uint8))), strides=(1,)).astype(np.uint64)[order]
        differ = key[1:] ^ key[:-1]
        low = np.zeros(n - 1, np.int16)
        for k in range(1, 9):
            low += differ < np.uint64(1 << (64 - 8 * k)) if k < 8 else differ == 0
        low[0] = 0  # the empty suffix
        value[1:n][low < 8] = low[low < 8]
        heads = np.flatnonzero(np.concatenate(([True], low < 8)))
        tails = np.append(heads[1:], n) - 1
        seeds = value[tails + 1] == 7
        seeds[-1] = False
        lo, hi, begin = heads[seeds], tails[seeds], 8
    for level in range(begin, length):
        one = lo == hi
        single = step[lo[one]]
        wide_lo, size = lo[~one], (hi - lo + 1)[~one]
        members = step[ranges(wide_lo, size)]
        group = np.repeat(np.arange(len(size)), size)
        by = np.argsort(members, kind="stable")
        members, group = members[by], group[by]
        new = np.ones(len(members) + 1, bool)
        if len(members):
            new[1:-1] = (members[1:] != members[:-1] + 1) | (group[1:] != group[:-1]) | letter[members[1:]]
        lo = np.concatenate((members[new[:-1]], single))
        hi = np.concatenate((members[new[1:]], single))
        open_ = value[hi + 1] < 0
        lo, hi = lo[open_], hi[open_]
        value[hi + 1] = level
        if not len(lo):
            break
    first = value[:-1] >= 0
    first[0] = True
    return order, first


def later_windows(text: np.ndarray, starts: np.ndarray, doc: np.ndarray, place: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of snippets laid out at ``starts`` (the last entry is the end) with document ranks and places: the runs of strings
    that are equal to an earlier one, as (snippet, begin, end) in bytes of the snippet."""
    order, first = shared_prefixes(text, length)
    which = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    offset = np.arange(len(text)) - starts[which]
    valid = np.append(offset + length <= np.diff(starts)[which], np.zeros(length + 1, bool))
    key = np.full(len(valid), np.iinfo(np.int64).max)
    key[: len(text)][valid[: len(text)]] = ((doc[which] << 32) | (place[which] + offset))[valid[: len(text)]]
    heads = np.flatnonzero(first)
    sorted_key = key[order]
    least = np.minimum.reduceat(sorted_key, heads)
    later = np.zeros(len(valid), bool)
    later[order] = (sorted_key != np.iinfo(np.int64).max) & (sorted_key > np.repeat(least, np.diff(np.append(heads, len(order)))))
    later = later[: len(text)]
    edge = np.diff(np.concatenate(([False], later, [False])).astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # a run never crosses snippets: the last length-1 offsets of each are not valid
    w = which[begin]
    return w, begin - starts[w], end - starts[w] + length - 1


def _anchors(docs: DataFrame, only: bool) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids, hashes = (batch.column(i).to_numpy() for i in (0, 1))
            for i, data, offsets in chunks(batch.column(2)):
                doc, begin, size, a, q = snippets(data, offsets)
                if only:
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64))], ["a"])
                    continue
                s = span_hash(data, begin, begin + size).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[i:][doc]), pa.array(hashes[i:][doc]), pa.array((begin - offsets[doc]).astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(a.view(np.int64)), pa.array(s), pa.array((q - offsets[doc]).astype(np.int32))], [*PLACES, "q"])

    return docs.mapInArrow(run, "a long" if only else "doc long, th int, start int, len int, a long, s long, q int")


ORDER = ["a", "s", "len", "doc", "th", "start"]
COPY, ALONE, FIRST = 0, 1, 2


def _heads(places: DataFrame, last: bool) -> DataFrame:
    """Places with their kind, from partitions that are sorted by ORDER: COPY of an equal snippet of the partition before
    it, or FIRST of its class. With ``last``, partitions hold whole anchors: a class that is alone under its anchor has
    nothing to be compared with and is left out. Places that occur twice (equal rows) count once.
    """

    own = [*PLACES, "q"]

    def emit(c: dict, kind: np.ndarray, on: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c[k][on]) for k in own] + [pa.array(kind[on])], [*own, "kind"])

    def run(batches):
        before, held, many = None, None, None  # last place, a first class held back, and the last anchor that has several
        for batch in batches:
            if not batch.num_rows:
                continue
            c = {k: batch.column(i).to_numpy() for i, k in enumerate(own)}
            old = {k: np.concatenate(([c[k][0] if before is None else before[k]], c[k][:-1])) for k in PLACES}
            same = np.ones(batch.num_rows, bool)
            for k in ("a", "s", "len"):
                same &= c[k] == old[k]
            twice = same.copy()
            for k in ("doc", "th", "start"):
                twice &= c[k] == old[k]
            if before is None:
                same[0] = twice[0] = False
            kind = np.where(same, COPY, FIRST).astype(np.int8)
            before = {k: c[k][-1] for k in PLACES}
            if not last:
                yield emit(c, kind, ~twice)
                continue
            if held is not None:  # it comes first, as it is sorted before
                c = {k: np.concatenate((held[k], c[k])) for k in own}
                kind, twice, held = np.concatenate(([FIRST], kind)).astype(np.int8), np.concatenate(([False], twice)), None
            new = np.concatenate(([True], c["a"][1:] != c["a"][:-1]))
            group = np.cumsum(new) - 1
            classes = np.bincount(group, kind == FIRST)
            several = classes > 1
            several[0] |= many is not None and c["a"][0] == many
            kind[(kind == FIRST) & ~several[group]] = ALONE
            tail = group == group[-1]
            if several[-1]:
                many = c["a"][-1]
            elif (open_ := np.flatnonzero(tail & (kind == ALONE))).size:
                held = {k: c[k][open_] for k in own}
            yield emit(c, kind, ~twice & (kind != ALONE))

    return places.sortWithinPartitions(*ORDER).mapInArrow(run, "doc long, th int, start int, len int, a long, s long, q int, kind byte")


def _bytes(firsts: DataFrame, docs: DataFrame) -> DataFrame:
    """``firsts`` with the bytes of each snippet."""
    per = firsts.groupBy("doc", "th").agg(F.collect_list(F.struct("start", "len", "a")).alias("parts"))

    def run(batches):
        for batch in batches:
            texts, rows, k = batch.column(2), batch.column(3), 0
            for i, data, offsets in chunks(texts):
                raw = data.tobytes()
                for k in range(len(offsets) - 1):
                    base = int(offsets[k])
                    parts = rows[i + k].values
                    start, size = (parts.field(f).to_numpy() for f in (0, 1))
                    n = len(start)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, batch.column(0)[i + k].as_py())), pa.array(np.full(n, batch.column(1)[i + k].as_py(), np.int32)), parts.field(0), parts.field(1), parts.field(2),
                         pa.array([raw[base + a : base + a + b] for a, b in zip(start.tolist(), size.tolist())], pa.binary())], ["doc", "th", "start", "len", "a", "bytes"])

    return docs.join(per, ["doc", "th"]).select("doc", "th", "text", "parts").mapInArrow(run, "doc long, th int, start int, len int, a long, bytes binary")


def _expand(classes: DataFrame) -> DataFrame:
    """(doc, th, begin, end): bytes of first snippets that a removed string covers."""

    def solve(rows: list) -> pa.RecordBatch:
        doc, th, start, size, raw = (np.concatenate([r[i] for r in rows]) if i < 4 else [x for r in rows for x in r[i]] for i in range(5))
        text = np.frombuffer(b"".join(raw), np.uint8)
        starts = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
        by = np.lexsort((th, doc))
        new = np.concatenate(([0], (doc[by][1:] != doc[by][:-1]) | (th[by][1:] != th[by][:-1])))
        rank = np.empty(len(doc), np.int64)
        rank[by] = np.cumsum(new)
        w, begin, end = later_windows(text, starts, rank, start.astype(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(doc[w]), pa.array(th[w]), pa.array((start[w] + begin).astype(np.int32)), pa.array((start[w] + end).astype(np.int32))], ["doc", "th", "begin", "end"])

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            a = batch.column(4).to_numpy()
            cuts = [0, *(np.flatnonzero(a[1:] != a[:-1]) + 1).tolist(), len(a)]
            lengths = np.concatenate(([0], np.cumsum(batch.column(3).to_numpy(), dtype=np.int64)))
            at = 0
            for k in range(len(cuts) - 1):
                same = k == 0 and rows and rows[-1][5] == a[0]
                if size + lengths[cuts[k]] - lengths[at] >= TEXT and not same:
                    if cuts[k] > at:
                        rows.append(_rows(batch, at, cuts[k], a))
                    if rows:
                        yield solve(rows)
                    rows, size, at = [], 0, cuts[k]
            if len(a) > at:
                rows.append(_rows(batch, at, len(a), a))
                size += int(lengths[-1] - lengths[at])
        if rows:
            yield solve(rows)

    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return classes.repartition(2 * n, "a").sortWithinPartitions("a").mapInArrow(run, "doc long, th int, begin int, end int")


def _rows(batch: pa.RecordBatch, a: int, b: int, anchors: np.ndarray) -> tuple:
    part = batch.slice(a, b - a)
    return (*(part.column(i).to_numpy() for i in range(4)), part.column(5).to_pylist(), anchors[b - 1])


def keyed(docs: DataFrame) -> DataFrame:
    """(doc, th, text): ids without nulls, and a hash of the text where ids repeat."""
    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    repeats = not docs.groupBy(ids).count().where("count > 1").isEmpty()
    # without repeats a zero, in a form that stays a key of joins
    return docs.select(ids.alias("doc"), (F.hash("text") if repeats else (ids % 1).cast("int")).alias("th"), "text")


def _split(hot: DataFrame, docs: DataFrame, step: int) -> DataFrame:
    """PLACES of the strings of ``hot`` snippets, dealt by the anchor's offset in them in steps, under keys of what stands around the anchor."""
    per = hot.groupBy("doc", "th").agg(F.collect_list(F.struct("start", "len", "q")).alias("parts"))
    texts = maybe_in(docs, F.col("doc"), per, F.col("doc"))

    def run(batches):
        for batch in batches:
            ids, hashes = (batch.column(i).to_numpy() for i in (0, 1))
            for i, data, offsets in chunks(batch.column(2)):
                lists = batch.column(3).slice(i, len(offsets) - 1)
                n = lists.value_lengths().to_numpy(zero_copy_only=False)
                flat = lists.flatten()
                start, size, q = (flat.field(f).to_numpy().astype(np.int64) for f in range(3))
                doc = np.repeat(np.arange(len(n)), n)
                begin, anchor, windows = start + offsets[doc], q + offsets[doc], size - LENGTH + 1
                # offsets of the anchor in the snippet's strings go from high down to low
                high = anchor - begin
                low = high - windows + 1
                first, many = low // step, high // step - low // step + 1
                k = ranges(first, many)
                row = np.repeat(np.arange(len(many)), many)
                lo, hi = k * step, np.minimum(k * step + step - 1, LENGTH - GRAM)
                b = np.maximum(begin[row], anchor[row] - hi)
                e = np.minimum(begin[row] + windows[row] - 1, anchor[row] - lo) + LENGTH
                key = mix(span_hash(data, anchor[row] - lo, anchor[row] + LENGTH - hi) + mix((k * 128 + step).astype(np.uint64)))
                at = doc[row]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[i:][at]), pa.array(hashes[i:][at]), pa.array((b - offsets[at]).astype(np.int32)), pa.array((e - b).astype(np.int32)), pa.array(key.view(np.int64)), pa.array(span_hash(data, b, e).view(np.int64)), pa.array(q[row].astype(np.int32))], [*PLACES, "q"])

    return texts.join(per, ["doc", "th"]).select("doc", "th", "text", "parts").mapInArrow(run, "doc long, th int, start int, len int, a long, s long, q int")


def removed(docs: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """Of ``keyed`` docs: tables of copies (doc, th, begin, end), and of the first snippets (PLACES) of classes that are to be compared with others."""
    met = written(_anchors(docs, True).groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a"), "met")
    # a hot anchor may be split by this join: what is first in a part of it is compared again below, the rest is copies
    places = maybe_in(_anchors(docs, False), F.col("a"), met, F.col("a"), 19).join(met, "a", "left_semi").select(*PLACES, "q")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    copies, firsts = [], []
    for step in (*STEPS, None):
        parts = written(_heads(places, False), "parts")
        once = parts.where(F.col("kind") == FIRST)
        copies.append(parts.where(F.col("kind") == COPY))
        hot = None
        if step:
            hot = written(once.groupBy("a").agg(F.sum("len").alias("bytes")).where(F.col("bytes") > HOT).select("a"), "hot")
            if hot.isEmpty():
                hot = None
        cold = once if hot is None else once.join(hot, "a", "left_anti")
        heads = written(_heads(cold.select(*PLACES, "q").repartition(n, "a"), True), "heads")
        copies.append(heads.where(F.col("kind") == COPY))
        firsts.append(heads.where(F.col("kind") == FIRST).select(*PLACES))
        if hot is None:
            break
        dealt = written(_split(once.join(hot, "a", "left_semi"), docs, step), "dealt")
        again = written(dealt.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a"), "met")
        places = maybe_in(dealt, F.col("a"), again, F.col("a"), 19).join(again, "a", "left_semi").select(*PLACES, "q")
    return [c.select("doc", "th", F.col("start").alias("begin"), (F.col("start") + F.col("len")).alias("end")) for c in copies], firsts


def dedup_bytes(docs: DataFrame, text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of ``docs(doc_id, text)``; with ``text`` also the bytes that stay."""
    base = keyed(docs)
    copies, firsts = removed(base)
    # texts that hold nothing to be removed or compared stay where they are; both joins with the others use one exchange
    holders = reduce(DataFrame.unionByName, [t.select("doc") for t in (*copies, *firsts)])
    flagged = maybe_flag(base, F.col("doc"), holders, F.col("doc"))
    placed = flagged.where("__maybe").drop("__maybe").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc", "th")
    cut = reduce(DataFrame.unionByName, [*copies, _expand(_bytes(reduce(DataFrame.unionByName, firsts), placed))])
    spans = cut.groupBy("doc", "th").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    joined = placed.join(spans, ["doc", "th"], "left").select("doc", "text", "spans")
    none = F.lit(None).cast(joined.schema["spans"].dataType)
    joined = joined.unionByName(flagged.where("not __maybe").select("doc", "text", none.alias("spans")))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * text

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, data, offsets in chunks(batch.column(1)):
                raw, out = data.tobytes(), []
                for k in range(len(offsets) - 1):
                    whole, spans = raw[offsets[k] : offsets[k + 1]], batch.column(2)[i + k]
                    parts, at, gone, runs = [], 0, 0, 0
                    if spans.is_valid:
                        begin, end = (spans.values.field(f).to_numpy() for f in (0, 1))
                        by = np.argsort(begin, kind="stable")
                        begin, end = begin[by], np.maximum.accumulate(end[by])
                        new = np.concatenate(([True], begin[1:] > end[:-1]))
                        for a, b in zip(begin[new].tolist(), end[np.append(new[1:], True)].tolist()):
                            parts.append(whole[at:a])
                            at, gone, runs = b, gone + b - a, runs + 1
                    parts.append(whole[at:])
                    kept = b"".join(parts)
                    doc = ids[i + k]
                    out.append((None if doc == -(2**63) else doc, len(whole), gone, runs, hashlib.sha256(kept).hexdigest(), kept))
                cols = list(zip(*out))
                types = [pa.int64()] * 4 + [pa.string(), pa.binary()]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
                keep = 5 + text
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[:keep], types[:keep])], names[:keep])

    return joined.mapInArrow(run, schema)
