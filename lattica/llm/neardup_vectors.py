"""Operator 5: embedding near-dedup by sorted projection passes.

Equal vectors (same label) are one class first. Each pass orders the classes
of a label lexicographically by the concatenated signs of its own random
projections, compares every class with its next ``WINDOW`` neighbours in that
order, and keeps the pairs whose cosine, in double precision, reaches the
bound. Within a sorted partition pairs are united at once, so a pass sends one
edge a class at most; edges of all passes are united to components. The
neighbours across a border of two partitions are compared in a stage of their
own, so the number of partitions changes no result.

Vectors are centred by their label first, as signs hardly split a label whose
vectors point the same way. How much a pass is worth is measured, not assumed.
With r being a class's distance from the centre, a partner at the bound lies
within asin(sqrt(2 - 2 * bound) / r) of its direction and agrees in each sign
with probability q or more; all classes that agree with it in the first l signs
stood in its window, l being one more than it shares with what lies just beyond
the window; so the pass misses a partner with probability 1 - q**l at most. A
class whose passes leave more than ``MISS`` in all is open: it is compared with
every class of its label, by blocks. So uneven and dense labels lose nothing;
where most classes are open that is quadratic in the label. The number of
passes follows the label's size and mean distance from its centre, and is
bounded by half of what comparing all pairs would take.

A window is bounded, a group of near copies isn't. So that every link in such a
group is counted, the classes of a component are dealt into blocks of about
``BLOCK``, and each pair of blocks is a task's group of its own that returns
one count a class: no pair is sent anywhere, and no task holds more than two
blocks.

Null labels, and vectors that are null, of length zero, of norm zero or with a
null or non-finite component, link with nothing; vectors of different length
don't either. Components of any finite size count: vectors are scaled by their
largest component before their norm is taken. Rows with the same vec_id are
vectors of their own that share the id. A null vec_id gives null for component
and kept.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, drop_written, written

WINDOW, BLOCK, MISS, BITS = 64, 2048, 1e-5, 60
#: Signs beyond log2(rows / WINDOW) that a window's end usually takes.
MARGIN = 1.5


def passes_for(rows: int, bound: float, spread: float = 1.0) -> int:
    """Passes for a label of so many classes with a mean squared distance ``spread`` of unit vectors from their centre."""
    near = 1 - (1 - bound) / max(spread, 1e-9)
    agree = 1 - math.acos(max(near, 0.0)) / math.pi
    hit = agree ** (max(0.0, math.log2(max(rows, 2) / WINDOW)) + MARGIN)
    return max(8, min(math.ceil(math.log(MISS) / math.log1p(-hit)), rows // (2 * WINDOW)))


def _unit(raw: np.ndarray) -> np.ndarray:
    raw = raw / np.abs(raw).max(1)[:, None]
    return raw / np.sqrt((raw * raw).sum(1))[:, None]


def _matrix(column, dim: int) -> np.ndarray:
    """Rows of doubles from binaries that hold floats or doubles."""
    raw = [*column]
    if all(len(v) == 8 * dim for v in raw):
        return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), dim)
    if all(len(v) == 4 * dim for v in raw):
        return np.frombuffer(b"".join(raw), np.float32).astype(np.float64).reshape(len(raw), dim)
    return np.stack([np.frombuffer(v, np.float64 if len(v) == 8 * dim else np.float32).astype(np.float64) for v in raw])


def _prepared(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, dim, vec): components as floats where these are exact, else as doubles; null where the vector links with nothing."""
    v = F.col("embedding")
    fine = F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            at = lists.offsets.to_numpy().astype(np.int64)
            wide = lists.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # one zero only
            small = wide.astype(np.float32)
            exact = np.concatenate(([0], np.cumsum(small.astype(np.float64) != wide)))
            exact = exact[at[1:]] == exact[at[:-1]]
            raw8, raw4, valid = wide.tobytes(), small.tobytes(), lists.is_valid().to_numpy(zero_copy_only=False)
            made = [None if not ok else raw4[4 * a : 4 * b] if e else raw8[8 * a : 8 * b] for ok, e, a, b in zip(valid, exact, at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(at).astype(np.int32)), pa.array(made, pa.binary())], ["vec_id", "label", "dim", "vec"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.when(fine, v.cast("array<double>")).alias("v")).mapInArrow(
        run, "vec_id long, label string, dim int, vec binary")


def _centred(classes: DataFrame, bound: float) -> DataFrame:
    """``classes`` with the centre of each label and dimension (of unit vectors), its number of classes and its passes."""

    def sums(batches):
        for batch in batches:
            frame = batch.to_pandas()
            for (label, dim), part in frame.groupby(["label", "dim"]):
                x = _unit(_matrix(part["vec"], dim))
                yield pa.RecordBatch.from_arrays([pa.array([label], pa.string()), pa.array([dim], pa.int32()), pa.array([len(x)]), pa.array([x.sum(0).tobytes()])], ["label", "dim", "size", "centre"])

    def whole(frame: pd.DataFrame) -> pd.DataFrame:
        dim, size = int(frame["dim"].iloc[0]), int(frame["size"].sum())
        centre = _matrix(frame["centre"], dim).sum(0) / size
        passes = passes_for(size, bound, 1 - float(centre @ centre))
        return pd.DataFrame({"label": frame["label"].iloc[:1], "dim": [dim], "size": [size], "centre": [centre.tobytes()], "passes": [passes]})

    parts = classes.select("label", "dim", "vec").mapInArrow(sums, "label string, dim int, size long, centre binary")
    centres = written(parts.groupBy("label", "dim").applyInPandas(whole, "label string, dim int, size long, centre binary, passes int"), "centres")
    return classes.join(centres, ["label", "dim"])


def _united(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``parent`` with the smallest place as root of all that pairs connect."""
    while len(a):  # hook the larger root below the smaller one until all pairs have one root
        pa_, pb = parent[a], parent[b]
        on = pa_ != pb
        if not on.any():
            break
        a, b, pa_, pb = a[on], b[on], pa_[on], pb[on]
        np.minimum.at(parent, np.maximum(pa_, pb), np.minimum(pa_, pb))
        while (parent != (up := parent[parent])).any():
            parent = up
    return parent


def _shared(group_a: np.ndarray, code_a: np.ndarray, group_b: np.ndarray, code_b: np.ndarray) -> np.ndarray:
    """Leading signs that two codes share; -1 where they are of different groups."""
    differ = code_a ^ code_b
    top = np.frexp((differ & ~(differ >> 1)).astype(np.float64))[1]  # the bit behind the first is cleared, so rounding moves no exponent
    return np.where(group_a == group_b, BITS - top, -1)


def _log_miss(q: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Log of the probability that a pass misses a partner, given the signs shared with what lies just beyond the window."""
    hit = np.where(shared >= BITS, 0.0, q ** np.maximum(shared + 1, 0))
    return np.log1p(-np.minimum(hit, 1 - 1e-12))


EDGE, CREDIT, BORDER = 0, 1, 2
FOUND = "kind int, a long, b long, score double, side int, border int, place int, pass int, label string, dim int, code long, vec binary, q double, known int"
FOUND_NAMES = [c.split()[0] for c in FOUND.split(", ")]


def _rows(n: int, **cols) -> pa.RecordBatch:
    """``n`` rows of FOUND: the given columns, the others null."""
    schema = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}
    arrays = []
    for name, kind in (c.split() for c in FOUND.split(", ")):
        v = cols.get(name)
        arrays.append(pa.nulls(n, schema[kind]) if v is None else pa.array(np.full(n, v) if np.isscalar(v) else v, schema[kind]))
    return pa.RecordBatch.from_arrays(arrays, FOUND_NAMES)


def _windows(frame: pd.DataFrame, group: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of at least the bound within WINDOW places of one group."""
    found_a, found_b = [np.zeros(0, int)], [np.zeros(0, int)]
    dims = frame["dim"].to_numpy()
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        x, mine = _unit(_matrix(frame["vec"].iloc[at], int(dim))), group[at]
        for lag in range(1, min(WINDOW, len(at) - 1) + 1):
            hit = np.flatnonzero((mine[:-lag] == mine[lag:]) & (np.einsum("ij,ij->i", x[:-lag], x[lag:]) >= bound))
            found_a.append(at[hit])
            found_b.append(at[hit + lag])
    return np.concatenate(found_a), np.concatenate(found_b)


def _passes(classes: DataFrame, bound: float, partitions: int) -> DataFrame:
    """FOUND rows of all passes: edges of verified pairs, united within each sorted partition, credits (log probability of a miss) and the rows around borders."""
    reach = math.sqrt(2 - 2 * bound)

    def code(batches):
        planes: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            frame = batch.to_pandas()
            for dim in np.unique(frame["dim"]):
                part = frame[frame["dim"] == dim]
                x = _unit(_matrix(part["vec"], dim)) - _matrix(part["centre"], dim)
                r = np.sqrt((x * x).sum(1))
                q = np.where(r > reach, 1 - np.arcsin(np.minimum(reach / np.maximum(r, 1e-300), 1.0)) / np.pi, 0.0)
                for p in range(int(part["passes"].max())):
                    on = (part["passes"] > p).to_numpy()
                    part, x, q = part[on], x[on], q[on]
                    if (p, dim) not in planes:
                        planes[p, dim] = np.random.default_rng([p, dim]).standard_normal((dim, BITS))
                    bits = x @ planes[p, dim] > 0
                    codes = (bits.astype(np.int64) << np.arange(BITS - 1, -1, -1)).sum(1)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part), p, np.int32)), pa.array(part["label"], pa.string()), pa.array(np.full(len(part), dim, np.int32)), pa.array(codes), pa.array(part["node"]), pa.array(part["vec"], pa.binary()), pa.array(q)],
                        ["pass", "label", "dim", "code", "node", "vec", "q"])

    def compare(batches):
        pid, frame, at, done = TaskContext.get().partitionId(), None, 0, 0  # at: place of the frame's first row in the partition; done: rows with a credit or in the head

        def settle(last: bool):
            """Credits of rows whose window is known, and border rows."""
            nonlocal done
            n, group, code = len(frame), frame["group"].to_numpy(), frame["code"].to_numpy()
            upto = at + n if last else at + n - WINDOW
            if upto <= done:
                return
            i = np.arange(done - at, upto - at)
            left, right = i - WINDOW, i + WINDOW
            low = np.where(left >= 0, _shared(group[i], code[i], group[np.maximum(left, 0)], code[np.maximum(left, 0)]), -1)
            high = np.where(right < n, _shared(group[i], code[i], group[np.minimum(right, n - 1)], code[np.minimum(right, n - 1)]), -1)
            # a group that the partition begins or ends with may go on beyond it
            unknown_left, unknown_right = (left < 0) & (at + left < 0) & (group[i] == 0), (right >= n) & (group[i] == group[-1])
            fine = ~unknown_left & ~unknown_right
            yield _rows(int(fine.sum()), kind=CREDIT, a=frame["node"].to_numpy()[i[fine]], score=_log_miss(frame["q"].to_numpy()[i[fine]], np.maximum(low, high)[fine]))
            for side, rows, known in ((0, unknown_left, np.where(unknown_right, BITS, high)), (1, unknown_right, np.where(unknown_left, BITS, low))):
                k = i[rows]
                if len(k):
                    yield _rows(len(k), kind=BORDER, side=side, border=pid + side, place=(at + k).astype(np.int32), a=frame["node"].to_numpy()[k], known=known[rows].astype(np.int32), **{c: frame[c].to_numpy()[k] for c in ("pass", "label", "dim", "code", "vec", "q")})
            done = upto

        for batch in batches:
            new = batch.to_pandas()
            if not len(new):
                continue
            if frame is not None:
                kept = frame.iloc[-2 * WINDOW :]
                at += len(frame) - len(kept)
                first = int(frame["group"].iloc[-1])
                new = pd.concat([kept.drop(columns="group"), new], ignore_index=True)
                first -= len({*kept["group"]}) - 1
            else:
                first = 0
            key = new[["pass", "label", "dim"]]
            new["group"] = first + (key != key.shift()).any(axis=1).iloc[1:].cumsum().reindex(new.index, fill_value=0)
            frame = new
            a, b = _windows(frame, frame["group"].to_numpy(), bound)
            parent = _united(np.arange(len(frame)), a, b)
            out = parent != np.arange(len(frame))
            node = frame["node"].to_numpy()
            yield _rows(int(out.sum()), kind=EDGE, a=node[out], b=node[parent[out]])
            yield from settle(False)
        if frame is not None:
            yield from settle(True)

    coded = classes.select("node", "label", "dim", "vec", "centre", "passes").mapInArrow(code, "pass int, label string, dim int, code long, node long, vec binary, q double")
    order = ["pass", "label", "dim", "code", "node"]
    return coded.repartitionByRange(partitions, *order).sortWithinPartitions(*order).mapInArrow(compare, FOUND)


def _borders(found: DataFrame, bound: float) -> DataFrame:
    """FOUND rows of the windows that cross a border of two partitions: at most twice WINDOW rows meet at one."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["side", "place"], ascending=[False, True], ignore_index=True)  # the end of the partition before comes first
        group = frame.groupby(["pass", "label", "dim"], sort=False).ngroup().to_numpy()
        a, b = _windows(frame, group, bound)
        n, code, side = len(frame), frame["code"].to_numpy(), frame["side"].to_numpy()
        i = np.arange(n)
        other = np.where(side == 1, i + WINDOW, i - WINDOW)  # the place just beyond the window on the far side
        there = (other >= 0) & (other < n)
        o = np.clip(other, 0, n - 1)
        far = _shared(group, code, group[o], code[o])
        # without a row there the group ends before it only if another group stands on that side, or nothing at all at the very begin
        ends = np.where(side == 1, group[-1] != group, (group[0] != group) | (frame["border"].iloc[0] == 0))
        far = np.where(there, far, np.where(ends, -1, BITS))
        score = _log_miss(frame["q"].to_numpy(), np.maximum(far, frame["known"].to_numpy()))
        node = frame["a"].to_numpy()
        return pd.DataFrame({"kind": [EDGE] * len(a) + [CREDIT] * n, "a": np.concatenate((node[a], node)), "b": np.concatenate((node[b], node)), "score": np.concatenate((np.zeros(len(a)), score))})

    return found.where(F.col("kind") == BORDER).groupBy("border").applyInPandas(run, "kind int, a long, b long, score double")


def _open_pairs(classes: DataFrame, bound: float) -> DataFrame:
    """Edges (a, b) that connect what is linked with the classes of ``classes(label, dim, node, vec, open)`` that are open, each compared with all of its label by pairs of blocks."""
    sizes = classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("all_blocks"), F.ceil(F.count_if("open") / F.lit(BLOCK)).alias("open_blocks")).where("open_blocks > 0")
    dealt = classes.join(sizes, ["label", "dim"])
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    rows = dealt.where("open").select("label", "dim", block("open_blocks").alias("i"), every("all_blocks").alias("j"), F.lit(True).alias("open"), "node", "vec").unionByName(
        dealt.select("label", "dim", every("open_blocks").alias("i"), block("all_blocks").alias("j"), F.lit(False).alias("open"), "node", "vec"))
    # a pair of blocks is much work in few bytes: dealt to all tasks, which adaptive execution would join by size
    rows = rows.repartition(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "label", "dim", "i", "j")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        x, node = _unit(_matrix(frame["vec"], int(frame["dim"].iloc[0]))), frame["node"].to_numpy()
        left, right = np.flatnonzero(frame["open"]), np.flatnonzero(~frame["open"])
        parent = np.arange(len(x))
        for at in range(0, len(left), 256):
            a, b = np.nonzero(_at_least(x[left[at : at + 256]], x[right], bound))
            parent = _united(parent, left[at + a], right[b])
        out = node[parent] != node
        return pd.DataFrame({"a": node[out], "b": node[parent[out]]})

    return rows.groupBy("label", "dim", "i", "j").applyInPandas(compare, "a long, b long")


def _links(members: DataFrame, bound: float) -> DataFrame:
    """(node, links): for each class of a component, the vectors of other classes that are linked with it."""
    blocks = members.groupBy("component").agg(F.count("*").alias("m")).where("m > 1").withColumn("blocks", F.ceil(F.col("m") / BLOCK))
    dealt = members.join(blocks, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = dealt.withColumn("other", other).select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "dim", "vec", "weight")
    # a pair of blocks is much work in few bytes: dealt to all tasks, which adaptive execution would join by size
    dealt = dealt.repartition(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), "component", "i", "j")

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        x = _unit(_matrix(frame["vec"], int(frame["dim"].iloc[0])))
        w, left = frame["weight"].to_numpy(), (frame["block"] == frame["i"]).to_numpy()
        out = np.zeros(len(frame), np.int64)
        if frame["i"].iloc[0] == frame["j"].iloc[0]:
            hit = _at_least(x, x, bound)
            np.fill_diagonal(hit, False)
            out = hit @ w
        else:
            hit = _at_least(x[left], x[~left], bound)
            out[left], out[~left] = hit @ w[~left], hit.T @ w[left]
        return pd.DataFrame({"node": frame["node"], "links": out})

    return dealt.groupBy("component", "i", "j").applyInPandas(count, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def _at_least(x: np.ndarray, y: np.ndarray, bound: float) -> np.ndarray:
    return x @ y.T >= bound


def near_vectors(vectors: DataFrame, bound: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of ``vectors(vec_id, embedding, label)``."""
    ready = written(_prepared(vectors), "vectors")
    fine = ready.where("vec is not null")
    # equal vectors are combined before the shuffle; the class is named by a number of its own as ids may be null or repeat
    classes = fine.groupBy("label", "dim", "vec").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    centred = written(_centred(classes, bound), "centred")
    compared = centred.agg(F.sum("passes")).first()[0] or 0
    partitions = max(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-compared // 20_000))
    found = written(_passes(centred, bound, partitions), "found")
    some = found.where(F.col("kind") != BORDER).select("kind", "a", "b", "score").unionByName(_borders(found, bound))
    some = written(some, "some")
    settled = some.where(F.col("kind") == CREDIT).groupBy(F.col("a").alias("node")).agg(F.sum("score").alias("score")).where(F.col("score") <= math.log(MISS)).select("node", F.lit(False).alias("open"))
    state = written(centred.select("label", "dim", "node", "vec").join(settled, "node", "left").withColumn("open", F.coalesce("open", F.lit(True))), "state")
    edges = some.where(F.col("kind") == EDGE).select("a", "b").distinct().unionByName(_open_pairs(state, bound))
    edges = written(edges, "edges")
    comp = written(components(edges), "components")
    for t in (centred, found, some, state, edges):
        drop_written(t)
    members = classes.join(comp, "node").select("component", "node", "dim", "vec", "weight")
    links = written(_links(members, bound), "links")
    smallest = classes.join(comp, "node").groupBy("component").agg(F.min("least").alias("smallest"))
    info = classes.join(comp, "node", "left").join(smallest, "component", "left").join(links, "node", "left").select(
        "label", "dim", "vec", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("smallest", "least").alias("smallest"))
    out = ready.join(info, ["label", "dim", "vec"], "left")
    component = F.coalesce(F.col("smallest"), F.col("vec_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
