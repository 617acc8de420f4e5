"""Operator 7: quality rules with n-gram perplexity.

Base rules count words, symbols, repeated lines and words in repeated
eight-word windows of each whole text. The model is an interpolated modified
Kneser-Ney model of code-point n-grams for each language. Spark counts the
n-grams of all documents that the base rules pass: every task sums its own
counts before the shuffle. Lower orders hold continuation counts, and the
three discounts of each order come from its counts of counts.

The model is a table for each order in the shared folder, with one row for each
distinct n-gram, however many there are, under a 64-bit hash. Nothing of it is
gathered or broadcast: ``BLOCK`` rows of a file are a block, each block's
distinct n-grams are joined with the model, and what a block asks for is stored
as sorted hash arrays, one file a block in the shared folder. Documents are
scored where they are read, by binary search in the arrays of their block; no
text is shuffled. An array file is written aside and renamed when it is whole,
so a repeated attempt of a lost task changes nothing.

Every document's perplexity is held against two bands of its language: the
median of the language plus ``UPPER`` and minus ``LOWER`` robust standard
deviations, and for short texts wider by the sampling error of their own length. Medians come
from histograms of all documents' log perplexities in steps of 0.001.

Nulls and texts without words have zero counts and fail the base rule. A null
language is a language. Rows are judged by themselves, so repeated rows and
repeated or null ids each get their verdict. An empty table gives an empty
result.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import drop_path, drop_written, new_path, placed, written
from .textnp import LANE, SPACE, chunks, mix, span_hash, spans, windows_hash

ORDER, BLOCK, REPEAT = 4, 4096, 8
#: Robust deviations above and below a language's median within which a text is kept; chosen on labelled rows of sf0.1 with even ids (README).
UPPER, LOWER = 2.5, 2.0
#: Log probability below the lowest order: one of the code points that Unicode has assigned.
FLOOR = float(np.log(1 / 150_000))
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
BASE_COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def per_doc(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def base_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The five counts of each document of a chunk."""
    n = len(offsets) - 1
    word = ~SPACE[data]
    starts, ends, doc = spans(word, offsets)
    out = {
        "n_words": np.bincount(doc, minlength=n), "word_chars": per_doc(word & ((data & 0xC0) != 0x80), offsets), "n_symbols": per_doc(SYMBOL[data], offsets),
        "n_dup_lines": np.zeros(n, np.int64), "n_repeat_words": np.zeros(n, np.int64),
    }
    lines, line_ends, line_doc = spans(data != 10, offsets)
    some = np.concatenate(([0], np.cumsum(word)))
    has = some[line_ends] > some[lines]
    lines, line_ends, line_doc = lines[has], line_ends[has], line_doc[has]
    hashes = span_hash(data, lines, line_ends)
    order = np.lexsort((hashes, line_doc))
    h, d = hashes[order], line_doc[order]
    again = d[1:][(h[1:] == h[:-1]) & (d[1:] == d[:-1])]
    out["n_dup_lines"] = np.bincount(again, minlength=n)
    hashes, at = windows_hash(span_hash(data, starts, ends), doc, REPEAT)
    order = np.lexsort((hashes, doc[at]))
    h, d = hashes[order], doc[at][order]
    same = (h[1:] == h[:-1]) & (d[1:] == d[:-1])
    twice = np.zeros(len(h), bool)
    twice[1:] |= same
    twice[:-1] |= same
    edge = np.zeros(len(starts) + REPEAT, np.int64)
    np.add.at(edge, at[order[twice]], 1)
    np.add.at(edge, at[order[twice]] + REPEAT, -1)
    covered = np.cumsum(edge)[: len(starts)] > 0
    out["n_repeat_words"] = np.bincount(doc[covered], minlength=n)
    return out


def failed(c: dict[str, np.ndarray]) -> np.ndarray:
    return (c["n_words"] < 20) | (100 * c["n_repeat_words"] > 30 * c["n_words"])


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a chunk and the offsets of documents in them."""
    lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32), lead[offsets]


def gram_keys(parts: list[np.ndarray], lang: np.ndarray) -> np.ndarray:
    """64-bit keys of n-grams given by their code points (first to last) and the hash of their language."""
    h = lang + np.uint64(len(parts))
    for at in range(0, len(parts), 2):  # two code points of 21 bits each make a lane
        lane = parts[at] if at + 1 == len(parts) else (parts[at] << np.uint64(21)) | parts[at + 1]
        h = mix(h ^ (lane * LANE))
    return (mix(h) if not parts else h).view(np.int64)


def lang_hashes(langs: list) -> np.ndarray:
    return mix(np.array([0 if x is None else 1 + zlib.crc32(x.encode()) for x in langs], np.uint64) * np.uint64(0xD1342543DE82EF95))


def histories(points: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each code point the ORDER ones that end in it, first to last, each plus 1; 0 pads the begin of a text."""
    out = []
    for k in range(ORDER - 1, -1, -1):
        c = np.zeros(len(points), np.uint64)
        c[k:] = points[: len(points) - k]
        c[k:] += np.uint64(1)
        for i in range(k):
            at = offsets[:-1] + i
            c[at[at < offsets[1:]]] = 0
        out.append(c)
    return out


def _tally(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams, as two numbers of two code points each, and their counts."""
    low = np.uint64(21)
    alphabet = np.flatnonzero(np.bincount(np.concatenate([parts[-1].astype(np.int64), [0]])))
    for p in parts[:-1]:  # a history may hold code points that only stand before the chosen documents' end
        if len(p) and int(p.max()) > int(alphabet[-1]):
            alphabet = np.append(alphabet, int(p.max()))
    if len(alphabet) < 65536:  # sort single numbers of four dense codes
        dense = np.zeros(int(alphabet[-1]) + 1, np.uint64)
        dense[alphabet] = np.arange(len(alphabet), dtype=np.uint64)
        key = dense[parts[0]]
        for p in parts[1:]:
            key = (key << np.uint64(16)) | dense[p]
        key.sort()
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        counts, key = np.diff(np.append(first, len(key))), key[first]
        c = [alphabet[(key >> np.uint64(16 * i)) & np.uint64(0xFFFF)].astype(np.uint64) for i in (3, 2, 1, 0)]
        return (c[0] << low) | c[1], (c[2] << low) | c[3], counts
    return _merge((parts[0] << low) | parts[1], (parts[2] << low) | parts[3], np.ones(len(parts[0]), np.int64))


def _merge(hi: np.ndarray, lo: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((lo, hi))
    hi, lo, counts = hi[order], lo[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1]))))
    return hi[first], lo[first], np.add.reduceat(counts, first)


def _counting(batches):
    """N-grams of the highest order by block: block, key, lang, p0 .. p3, count in documents that the base rules pass (0 in others only)."""
    kept: dict = {}

    def merged(at):
        kept[at] = [tuple(_merge(*(np.concatenate(x) for x in zip(*kept[at]))))]
        return kept[at][0]

    def out(at):
        hi, lo, counts = merged(at)
        del kept[at]
        low, n = np.uint64((1 << 21) - 1), np.uint64(21)
        cols, (block, lang) = [hi >> n, hi & low, lo >> n, lo & low], at
        key = gram_keys(cols, lang_hashes([lang]).repeat(len(hi)))
        arrays = [pa.array(np.full(len(hi), block)), pa.array(key), pa.array([lang] * len(hi), pa.string()), *(pa.array(c.astype(np.int32)) for c in cols), pa.array(counts)]
        return pa.RecordBatch.from_arrays(arrays, ["block", "key", "lang", *(f"p{i}" for i in range(ORDER)), "count"])

    for batch in batches:
        langs, blocks = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        for i, data, offsets in chunks(batch.column(0)):
            bad = failed(base_counts(data, offsets))
            points, at = code_points(data, offsets)
            parts, doc = histories(points, at), np.repeat(np.arange(len(at) - 1), np.diff(at))
            names = list(zip(blocks[i : i + len(offsets) - 1], langs[i : i + len(offsets) - 1]))
            for name in set(names):
                mine = np.array([x == name for x in names])
                for chosen, counts in ((mine & ~bad, 1), (mine & bad, 0)):
                    rows = chosen[doc]
                    if rows.any():
                        hi, lo, times = _tally([p[rows] for p in parts])
                        kept.setdefault(name, []).append((hi, lo, times * counts))
                if sum(len(x[0]) for x in kept.get(name, ())) > 600_000 and len(merged(name)[0]) > 300_000:
                    yield out(name)  # a block may have more rows than one for an n-gram
            for name in [x for x in kept if x[0] not in blocks[i:]]:
                yield out(name)
    for name in list(kept):
        yield out(name)


class Model:
    """The model as written tables: ``requests(block, key)`` of the documents, for each order ``grams(key, prob)`` and ``contexts(context, weight)``.

    ``grams`` has all n-grams of the documents, also those that only documents have that it isn't trained on.
    """

    def __init__(self, requests: DataFrame, grams: list[DataFrame], contexts: list[DataFrame], tables: list[DataFrame]):
        self.requests, self.grams, self.contexts, self.tables, self.arrays = requests, grams, contexts, tables, None

    def drop(self) -> None:
        """Delete the written tables."""
        for t in self.tables:
            drop_written(t)

    def nll(self, points: np.ndarray, offsets: np.ndarray, lang: np.ndarray) -> np.ndarray:
        """Negative log probability of each code point of any text, on the driver: gathers the tables, so it is for small models only."""
        if self.arrays is None:
            read = lambda tables: [{k: v for k, v in zip(*(c.to_numpy() for c in t.toArrow().columns))} for t in tables]
            self.arrays = read(self.grams), read(self.contexts)
        grams, contexts = self.arrays
        parts, lang = histories(points, offsets), np.repeat(lang, np.diff(offsets))
        keys = [gram_keys(parts[ORDER - n :], lang).tolist() for n in range(ORDER + 1)]
        before = [None] + [gram_keys(parts[ORDER - n : ORDER - 1], lang).tolist() for n in range(1, ORDER + 1)]
        out = np.zeros(len(points))
        for i in range(len(points)):
            for n in range(ORDER, 0, -1):
                if keys[n][i] in grams[n - 1]:
                    out[i] += np.log(grams[n - 1][keys[n][i]])
                    break
                out[i] += contexts[n - 1].get(before[n][i], 0.0)
            else:
                out[i] += FLOOR
        return -out


def _found(keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Places in the sorted unsigned ``keys`` of ``asked``, all of which are there: binary search, its first steps by a table of leading bits."""
    shift = np.uint64(64 - min(26, len(keys).bit_length() + 2))
    first = np.searchsorted(keys >> shift, np.arange(1 << (64 - int(shift)), dtype=np.uint64)).astype(np.int32)
    at = first[asked >> shift]
    miss = np.flatnonzero(keys[at] != asked)
    while len(miss):
        at[miss] += 1
        miss = miss[keys[at[miss]] != asked[miss]]
    return at


def _blocks(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__block``: up to BLOCK rows of one Parquet file, the same in every scan."""
    return placed(docs).withColumn("__block", F.xxhash64("__file", F.floor(F.col("__at") / BLOCK))).drop("__file", "__at")


class Arrays:
    """The probabilities that each block asks for: files of sorted hashes and losses under ``path``."""

    def __init__(self, model: Model, path: str):
        self.path = path
        asked = model.requests.join(model.grams[-1], "key").select("block", "key", "prob")

        def save(table: pa.Table) -> pa.Table:
            return _save(path, table)

        written(asked.groupBy("block").applyInArrow(save, "block long, n long"), "saved")

    @staticmethod
    def load(path: str, block: int) -> tuple[np.ndarray, np.ndarray]:
        fs, base = pafs.FileSystem.from_uri(path)
        name = f"{base}/{block & (2**64 - 1):016x}"
        if fs.get_file_info(name).type == pafs.FileType.NotFound:  # a block without a code point asks for nothing
            return np.zeros(0, np.uint64), np.zeros(0, np.float32)
        with fs.open_input_file(name) as f:
            raw = f.read()
        n = len(raw) // 12
        return np.frombuffer(raw, np.uint64, n), np.frombuffer(raw, np.float32, n, 8 * n)


def _save(path: str, table: pa.Table) -> pa.Table:
    """Write the arrays of a block: its sorted keys, then their losses."""
    fs, base = pafs.FileSystem.from_uri(path)
    fs.create_dir(base, recursive=True)
    keys, first = np.unique(table["key"].to_numpy().view(np.uint64), return_index=True)
    block = table["block"][0].as_py()
    name = f"{base}/{block & (2**64 - 1):016x}"
    aside = f"{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(aside) as out:
        out.write(keys.tobytes() + (-np.log(table["prob"].to_numpy()[first])).astype(np.float32).tobytes())
    if fs.get_file_info(name).type == pafs.FileType.NotFound:
        fs.move(aside, name)
    else:
        fs.delete_file(aside)
    return pa.table({"block": pa.array([block]), "n": pa.array([len(keys)])})


def train(docs: DataFrame) -> Model:
    """Count the n-grams of ``docs(text, lang)``, or of what ``_blocks`` made of it, and estimate the model."""
    docs = docs if "__block" in docs.columns else _blocks(docs)
    points = ", ".join(f"p{i} int" for i in range(ORDER))
    counted = docs.select("text", "lang", "__block").mapInArrow(_counting, f"block long, key long, lang string, {points}, count long")
    counted = written(counted, "counted")
    tables = [counted]
    p = [F.col(f"p{i}") for i in range(ORDER)]
    top = written(counted.groupBy("key", "lang", *p).agg(F.sum("count").alias("count")).drop("key"), "grams")
    orders = {ORDER: top}
    for n in range(ORDER - 1, 0, -1):  # continuation counts: distinct code points before the n-gram
        up = orders[n + 1]
        own = [f"p{i}" for i in range(ORDER - n, ORDER)]
        orders[n] = written(up.groupBy("lang", *own).agg(F.count_if(F.col("count") > 0).alias("count")), "grams")
    made, contexts = [], []
    for n in range(1, ORDER + 1):
        grams = written(_hashed(orders[n], n), "hashed")
        drop_written(orders[n])
        of = {r[0]: r[1] for r in grams.where("count between 1 and 4").groupBy("count").agg(F.count("*")).collect()}
        n1, n2, n3, n4 = (of.get(i, 0) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        d = [min(max(v, 0.05), i - 0.05) for i, v in ((1, 1 - 2 * y * n2 / n1 if n1 else 0.5), (2, 2 - 3 * y * n3 / n2 if n2 else 1.0), (3, 3 - 4 * y * n4 / n3 if n3 else 1.5))]
        count = F.col("count")
        discount = F.when(count == 1, d[0]).when(count == 2, d[1]).otherwise(d[2])
        off = F.count_if(count == 1) * d[0] + F.count_if(count == 2) * d[1] + F.count_if(count > 2) * d[2]
        totals = written(grams.where("count > 0").groupBy("context").agg(F.sum("count").alias("total"), off.alias("off")), "totals")
        rows = grams.join(totals, "context", "left")
        if n == 1:
            rows = rows.withColumn("base", F.lit(float(np.exp(FLOOR))))
        else:
            rows = rows.join(made[-1].select(F.col("key").alias("lower"), F.col("prob").alias("base")), "lower")
        seen = F.when(count > 0, (count - discount) / F.col("total")).otherwise(0.0)
        rest = F.coalesce(F.col("off") / F.col("total"), F.lit(1.0))  # a context that nothing is known of
        made.append(written(rows.select("key", F.greatest(seen + rest * F.col("base"), F.lit(1e-12)).alias("prob")), "model"))
        contexts.append(totals.select("context", F.log(F.col("off") / F.col("total")).alias("weight")))
        drop_written(grams)
        tables.append(totals)
    return Model(counted.select("block", "key"), made, contexts, [*tables, *made])


def _hashed(grams: DataFrame, n: int) -> DataFrame:
    """(key, context, lower, count) of n-grams given by code points."""

    def run(batches):
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            names = [*langs.dictionary.to_pylist(), None]
            lang = lang_hashes(names)[pc.fill_null(langs.indices, len(names) - 1).to_numpy(zero_copy_only=False)]
            cols = [batch.column(1 + i).to_numpy().astype(np.uint64) for i in range(n)]
            made = [gram_keys(cols, lang), gram_keys(cols[:-1], lang), gram_keys(cols[1:], lang)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, made), batch.column(n + 1)], ["key", "context", "lower", "count"])

    return grams.select("lang", *[f"p{i}" for i in range(ORDER - n, ORDER)], "count").mapInArrow(run, "key long, context long, lower long, count long")


def scored(docs: DataFrame, path: str, keep: list[str], text: str = "text", lang: str = "lang") -> DataFrame:
    """``keep`` with the base counts, base_failed, chars, nll (mean over code points) and nll2 (mean square) of ``docs``, the ``_blocks`` that the ``Arrays`` under ``path`` are of."""
    added = [*(T.StructField(c, T.LongType()) for c in BASE_COLUMNS), T.StructField("base_failed", T.BooleanType()), T.StructField("__lang", T.StringType()), *(T.StructField(c, T.DoubleType()) for c in ("__n", "__nll", "__nll2"))]
    new = {f.name for f in added}
    keep = [c for c in keep if c not in new]
    extra = [c for c in dict.fromkeys((text, lang)) if c not in keep]
    place = [*keep, *extra].index(text), [*keep, *extra].index(lang)

    def run(batches):
        held = None
        for batch in batches:
            blocks, names = batch.column(batch.num_columns - 1).to_numpy(), batch.column(place[1]).to_pylist()
            cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
            for lo, hi in zip(cuts, cuts[1:]):
                if held is None or held[0] != blocks[lo]:
                    held = blocks[lo], *Arrays.load(path, int(blocks[lo]))
                for i, data, offsets in chunks(batch.column(place[0]).slice(lo, hi - lo), 1 << 19):
                    c, n = base_counts(data, offsets), len(offsets) - 1
                    points, at = code_points(data, offsets)
                    size, own = np.diff(at), names[lo + i : lo + i + n]
                    asked = gram_keys(histories(points, at), np.repeat(lang_hashes(own), size)).view(np.uint64)
                    nll = held[2][_found(held[1], asked)].astype(float) if len(asked) else np.zeros(0)
                    sums = [np.diff(np.concatenate(([0.0], np.cumsum(v)))[at]) for v in (nll, nll * nll)]
                    mean = [np.round(s / np.maximum(size, 1), 9) for s in sums]
                    cols = [batch.column(k).slice(lo + i, n) for k in range(len(keep))]
                    cols += [pa.array(c[k]) for k in BASE_COLUMNS] + [pa.array(failed(c)), pa.array(own, pa.string()), pa.array(size.astype(float)), *map(pa.array, mean)]
                    yield pa.RecordBatch.from_arrays(cols, [*keep, *(f.name for f in added)])

    source = docs.select(*[F.col(f"`{c}`") for c in [*keep, *extra]], "__block")
    return source.mapInArrow(run, T.StructType([*(docs.schema[c] for c in keep), *added]))


def _judged(blocks: DataFrame, docs: DataFrame, keep: list[str], text: str = "text", lang: str = "lang") -> DataFrame:
    """``scored`` of ``docs`` as a written table, by a model of ``blocks``, both of the same rows; tables on the way are deleted."""
    model, path = train(blocks), new_path(docs.sparkSession, "arrays")
    Arrays(model, path)
    model.drop()
    out = written(_keyed(scored(docs, path, keep, text, lang)), "judged")
    drop_path(docs.sparkSession, path)
    return out


def bands(judged: DataFrame) -> DataFrame:
    """(__key, mid, spread, noise): median and robust deviation of the log perplexity, deviation of one code point."""
    base = judged.where("not base_failed").withColumn("step", F.round(F.col("__nll") * 1000).cast("long"))
    hist = base.groupBy("__key", "step").agg(F.count("*").alias("n"), F.sum(F.col("__n") * (F.col("__nll2") - F.col("__nll") * F.col("__nll"))).alias("var"), F.sum("__n").alias("chars"))

    def median(h: DataFrame, value: str, out: str) -> DataFrame:
        w = Window.partitionBy("__key")
        summed = h.groupBy("__key", value).agg(F.sum("n").alias("n")).withColumns({"run": F.sum("n").over(w.orderBy(value)), "all": F.sum("n").over(w)})
        return summed.where(F.col("run") * 2 >= F.col("all")).groupBy("__key").agg(F.min(value).alias(out))

    mid = median(hist, "step", "mid")
    off = hist.join(mid, "__key").select("__key", "n", F.abs(F.col("step") - F.col("mid")).alias("off"))
    noise = hist.groupBy("__key").agg(F.sqrt(F.sum("var") / F.greatest(F.sum("chars"), F.lit(1.0))).alias("noise"))
    out = mid.join(median(off, "off", "mad"), "__key").join(noise, "__key")
    return out.select("__key", (F.col("mid") / 1000).alias("mid"), (F.col("mad") / 1000 * 1.4826).alias("spread"), "noise")


def _held(judged: DataFrame) -> DataFrame:
    """``judged`` (a written table) with ``kept``: the verdict of base rules and bands."""
    band = written(bands(judged), "bands")
    room = F.sqrt(F.col("spread") * F.col("spread") + F.col("noise") * F.col("noise") / F.greatest(F.col("__n"), F.lit(1.0)))
    inside = (F.col("__nll") - F.col("mid")).between(-LOWER * room, UPPER * room)
    return judged.drop("kept").join(band, "__key", "left").withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))


def _keyed(judged: DataFrame) -> DataFrame:
    return judged.withColumn("__key", F.coalesce(F.concat(F.lit("="), "__lang"), F.lit("")))


def judge(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (default: all columns; added columns replace those of their name) with the base counts, base_failed,
    perplexity and kept."""
    blocks = _blocks(docs)
    judged = _judged(blocks, blocks, docs.columns if keep is None else keep)
    plain = [c for c in judged.columns if not c.startswith("__") and c not in ("kept", "perplexity")]
    return _held(judged).select(*[F.col(f"`{c}`") for c in plain], F.exp("__nll").alias("perplexity"), "kept")


def filter_kept(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with its columns."""
    blocks, columns = _blocks(docs), docs.columns
    own = {c: f"__c{i}" for i, c in enumerate(columns)}
    renamed = blocks.select(*[F.col(f"`{c}`").alias(k) for c, k in own.items()], "__block")
    judged = _judged(blocks, renamed, list(own.values()), own["text"], own["lang"])
    return _held(judged).where("kept").select(*[F.col(k).alias(c) for c, k in own.items()])
