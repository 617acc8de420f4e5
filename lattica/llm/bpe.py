"""Operator 1: byte-level BPE encoding and decoding.

Distinct pieces of a batch are laid out as padded matrices, one for each
length bucket. In every round each row merges its leftmost pair of least rank,
pairs are ranked by an open-addressing hash table in arrays, and the matrix is
compacted (merged cells close up, finished rows leave). Pieces beyond
``FOLD`` bytes are matrices of their own: the row is folded into blocks whose
least ranks are kept, so a round costs the square root of the length.

A worker remembers the ids of pieces. They are found by a hash and compared
byte by byte: two eight-byte lanes and the length tell pieces of up to 16 bytes
apart, the bytes themselves longer ones.

Nulls and empty texts give no ids. Repeated rows each give their row.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .textnp import LANE, chunks, lanes_of, masked, mix, ranges, span_hash

NONE = np.int32(2**31 - 1)
#: Bytes from which a piece is folded into blocks, and cells of a matrix at most (one row at least).
FOLD, AREA = 1024, 1 << 22
#: Pieces a worker remembers; then it starts anew. Bounds memory only.
REMEMBERED = 300_000


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Vocabulary:
    """Ranks with an array hash table of mergeable pairs, and tables for decoding."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pieces, self.whole = Pieces(pattern), ranks
        self.bytes_id = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        if (self.bytes_id < 0).any():
            raise ValueError("every single byte needs a rank")
        self.size = max(ranks.values()) + 1
        tokens = [b""] * self.size
        for t, r in ranks.items():
            tokens[r] = t
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        found = {}
        for t, r in ranks.items():
            for i in range(1, len(t)):
                a, b = ranks.get(t[:i]), ranks.get(t[i:])
                if a is not None and b is not None:
                    found[a * self.size + b] = r
        keys = np.fromiter(found.keys(), np.int64, len(found))
        values = np.fromiter(found.values(), np.int32, len(found))
        self.bits = max(4, (2 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            rest = np.ones(len(keys), bool)
            rest[put] = False
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair of ids (-1: padding), NONE where there is none."""
        keys = left.astype(np.int64) * self.size + right
        out = np.full(keys.shape, NONE, np.int32)
        todo = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        flat, keys = out.reshape(-1), keys.reshape(-1)[todo]
        slot = self._slot(keys)
        while len(todo):
            there = self.keys[slot]
            hit = there == keys
            flat[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (there >= 0)
            todo, keys, slot = todo[on], keys[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece."""
        out: list[np.ndarray | None] = [None] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (r := self.whole.get(p)) is not None:
                out[i] = np.array([r], np.int32)
            elif len(p) > FOLD:
                out[i] = self._folded(p)
            else:
                buckets.setdefault(len(p).bit_length(), []).append(i)
        for members in buckets.values():
            rows = max(1, AREA >> max(9, len(pieces[members[0]]).bit_length()))
            for at in range(0, len(members), rows):
                self._bucket(pieces, members[at : at + rows], out)
        return out

    def _bucket(self, pieces: list[bytes], rows: list[int], out: list) -> None:
        lengths = np.array([len(pieces[i]) for i in rows])
        width = int(lengths.max())
        cells = np.full((len(rows), width), -1, np.int32)
        cells[np.arange(width) < lengths[:, None]] = self.bytes_id[np.frombuffer(b"".join(pieces[i] for i in rows), np.uint8)]
        at = np.array(rows)
        ranks = self.rank(cells[:, :-1], cells[:, 1:])
        while True:
            line = np.arange(len(cells))
            j = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(cells), int)
            best = ranks[line, j] if ranks.shape[1] else np.full(len(cells), NONE)
            done = best == NONE
            if done.any():
                for i, ids in zip(at[done], cells[done]):
                    out[i] = ids[ids >= 0]
                on = ~done
                if not on.any():
                    return
                cells, ranks, at, j, best = cells[on], ranks[on], at[on], j[on], best[on]
                line = np.arange(len(cells))
            cells[line, j] = best
            stay = np.ones(cells.shape, bool)
            stay[line, j + 1] = False
            cells = cells[stay].reshape(len(cells), -1)
            stay = stay[:, 1:]  # the pair behind the merged one goes, or the last pair itself
            ranks = ranks[stay].reshape(len(cells), -1)
            if not ranks.shape[1]:
                continue
            has = j < ranks.shape[1]
            ranks[line[has], j[has]] = self.rank(cells[line[has], j[has]], cells[line[has], j[has] + 1])
            has = j > 0
            ranks[line[has], j[has] - 1] = self.rank(cells[line[has], j[has] - 1], cells[line[has], j[has]])

    def _folded(self, piece: bytes) -> np.ndarray:
        n = len(piece)
        ids = self.bytes_id[np.frombuffer(piece, np.uint8)].copy()
        width = int(n**0.5) + 1
        ranks = np.full(-(-n // width) * width, NONE, np.int32)
        ranks[: n - 1] = self.rank(ids[:-1], ids[1:])
        folded = ranks.reshape(-1, width)
        least = folded.min(1)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        known: dict[tuple[int, int], int] = {}

        def one(a: int, b: int) -> int:
            if (r := known.get((a, b))) is None:
                r = known[a, b] = int(self.rank(np.array([a]), np.array([b]))[0])
            return r

        while True:
            block = int(least.argmin())
            if (best := least[block]) == NONE:
                return ids[ids >= 0]
            i = block * width + int(folded[block].argmin())
            gone = after[i]
            ids[i], ids[gone], ranks[gone] = best, -1, NONE
            nxt = after[i] = after[gone]
            if nxt < n:
                before[nxt] = i
            ranks[i] = one(int(ids[i]), int(ids[nxt])) if nxt < n else NONE
            p = before[i]
            if p >= 0:
                ranks[p] = one(int(ids[p]), int(ids[i]))
            for b in {block, gone // width, max(p, 0) // width}:
                least[b] = folded[b].min()

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of a sequence of ids."""
        ids = np.asarray(ids, np.int64)
        return self.flat[ranges(self.starts[ids], self.lengths[ids])].tobytes()


LETTER, NUMBER, OTHER, BLANK = 0, 1, 2, 3


class Pieces:
    """Cuts chunks of documents into the matches of the pattern.

    For the pattern whose alternatives are contractions, optional space with
    letters, numbers or others, and white space, all cuts of a chunk are found
    at once from the classes of its code points. Any other pattern is matched
    by the regex library.
    """

    FAST = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, pattern: str):
        import regex

        self.fast = pattern == self.FAST
        # white space is the Unicode property here, without U+001C..U+001F
        self.pattern = pattern.replace(r"[^\s\p", r"[^\p{White_Space}\p").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")
        if self.fast:
            self.classes = np.full(0x110000, OTHER, np.uint8)
            every = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000])
            text = "".join(map(chr, every))
            for kind, name in ((LETTER, "L"), (NUMBER, "N"), (BLANK, "White_Space")):
                for m in regex.finditer(rf"\p{{{name}}}+", text):
                    self.classes[every[m.start() : m.end()]] = kind

    def cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Byte offsets where pieces start."""
        if not self.fast:
            import regex

            find, out = regex.compile(self.pattern), []
            for a, b in zip(offsets[:-1], offsets[1:]):
                text = data[a:b].tobytes().decode()
                at, last = int(a), 0
                for m in find.finditer(text):
                    at += len(text[last : m.start()].encode())
                    out.append(at)
                    last = m.start()
            return np.array(out, np.int64)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        n = len(points)
        if not n:
            return np.zeros(0, np.int64)
        kind = self.classes[points]
        first = np.zeros(n + 3, bool)  # first code points of documents
        first[np.searchsorted(lead, offsets)] = True
        run = first[:n].copy()
        run[1:] |= kind[1:] != kind[:-1]
        cut = run.copy()
        after = np.flatnonzero(run[1:] & ~first[1:n] & (kind[:-1] == BLANK)) + 1  # what follows white space in its document
        cut[after - 1] = True
        cut[after[points[after - 1] == 0x20]] = False
        quote = np.flatnonzero((points[:-1] == 0x27) & cut[:-1] & run[1:] & ~first[1:n])
        if len(quote):
            p = np.concatenate((points, np.zeros(3, np.uint32)))
            one, two = p[quote + 1], np.where(first[quote + 2], 0, p[quote + 2])
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = ~short & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
            for hit, size in ((quote[short], 2), (quote[long], 3)):
                cut[hit + 1] = False
                end = hit + size
                end = end[end < n]
                cut[end[(kind[end] == LETTER) & ~first[end]]] = True
        return lead[cut]


class Encoder:
    """Encodes chunks of documents; remembers pieces, with their bytes, up to a bound."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = v = vocabulary
        digits = [f"{i}," for i in range(v.size)]
        self.digit_lengths = np.array([len(d) for d in digits])
        self.digit_starts = np.cumsum(self.digit_lengths) - self.digit_lengths
        self.digits = np.frombuffer("".join(digits).encode(), np.uint8)
        self._forget(20)

    def _forget(self, bits: int) -> None:
        self.bits, self.n = bits, 0
        self.where = np.full(1 << bits, -1, np.int32)
        # of each remembered piece: its lanes, length, place of its bytes (beyond 16) and of its ids
        self.one, self.two, self.sizes, self.at = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.long = np.zeros(0, np.uint8)
        self.starts, self.counts, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _same(self, known: np.ndarray, one: np.ndarray, two: np.ndarray, sizes: np.ndarray, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Which of the remembered pieces ``known`` have the bytes of the pieces at ``starts``."""
        same = (self.one[known] == one) & (self.two[known] == two) & (self.sizes[known] == sizes)
        far = np.flatnonzero(same & (sizes > 16))
        if len(far):
            size = sizes[far]
            equal = self.long[ranges(self.at[known[far]], size)] == data[ranges(starts[far], size)]
            same[far] = np.logical_and.reduceat(equal, np.cumsum(size) - size)
        return same

    def _look(self, h: np.ndarray, one: np.ndarray, two: np.ndarray, sizes: np.ndarray, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Numbers of remembered pieces, -1 where a piece is unknown."""
        out, todo = np.full(len(h), -1, np.int32), np.arange(len(h))
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(todo):
            at = self.where[slot]
            full = np.flatnonzero(at >= 0)
            todo, slot, at = todo[full], slot[full], at[full]
            hit = self._same(at, one[todo], two[todo], sizes[todo], data, starts[todo])
            out[todo[hit]] = at[hit]
            todo, slot = todo[~hit], (slot[~hit] + 1) & ((1 << self.bits) - 1)
        return out

    def _learn(self, h: np.ndarray, one: np.ndarray, two: np.ndarray, sizes: np.ndarray, pieces: list[bytes]) -> None:
        made = self.vocabulary.encode_pieces(pieces)
        counts = np.array([len(x) for x in made])
        self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(counts) - counts))
        self.counts, self.ids = np.concatenate((self.counts, counts)), np.concatenate((self.ids, *made))
        kept = np.where(sizes > 16, sizes, 0)
        self.at = np.concatenate((self.at, len(self.long) + np.cumsum(kept) - kept))
        self.long = np.concatenate((self.long, np.frombuffer(b"".join(p for p in pieces if len(p) > 16), np.uint8)))
        self.one, self.two, self.sizes = np.concatenate((self.one, one)), np.concatenate((self.two, two)), np.concatenate((self.sizes, sizes))
        slot, number = (h >> np.uint64(64 - self.bits)).astype(np.int64), np.arange(self.n, self.n + len(h), dtype=np.int32)
        self.n += len(h)
        while len(slot):
            free = np.flatnonzero(self.where[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.where[slot[put]] = number[put]
            rest = np.ones(len(slot), bool)
            rest[put] = False
            number, slot = number[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the documents of a chunk, one after the other, and their offsets."""
        starts = self.vocabulary.pieces.cuts(data, offsets)
        sizes = np.append(starts[1:], len(data)) - starts
        lanes = lanes_of(data)
        one, two = masked(lanes[starts], sizes), masked(lanes[np.minimum(starts + 8, len(data))], sizes - 8)
        h = mix(one * LANE ^ mix(two + sizes.astype(np.uint64)))
        far = np.flatnonzero(sizes > 16)
        h[far] = span_hash(data, starts[far], starts[far] + sizes[far])
        if self.n > REMEMBERED:
            self._forget(20)
        piece = h, one, two, sizes
        at, raw = self._look(*piece, data, starts), data.tobytes()
        while len(miss := np.flatnonzero(at < 0)):  # pieces of equal hash are learnt one after the other
            _, first = np.unique(h[miss], return_index=True)
            if self.n + len(first) > 3 << (self.bits - 2):
                self._forget(max(20, int(2 * len(h)).bit_length()))
                at[:] = -1
                continue
            pick = miss[first]
            self._learn(*(x[pick] for x in piece), [raw[a : a + b] for a, b in zip(starts[pick].tolist(), sizes[pick].tolist())])
            at[miss] = self._look(*(x[miss] for x in piece), data, starts[miss])
        counts = self.counts[at]
        ids = self.ids[ranges(self.starts[at], counts)]
        total = np.concatenate(([0], np.cumsum(counts)))
        return ids, total[np.searchsorted(starts, offsets)]

    def decimal(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Decimal ids, a comma behind each, and the offsets of documents."""
        n = self.digit_lengths[ids]
        return self.digits[ranges(self.digit_starts[ids], n)], np.concatenate(([0], np.cumsum(n)))[offsets]


#: The encoder of this worker and the vocabulary it is for.
_encoder: list = [None, None]


def encoder_of(v: Vocabulary) -> Encoder:
    if _encoder[0] is not v:
        _encoder[:] = v, Encoder(v)
    return _encoder[1]


def encode(df: DataFrame, vocabulary: Vocabulary, text: str = "text", keep: list[str] | None = None, ids: bool = True, digests: bool = False) -> DataFrame:
    """The columns ``keep`` (default: all but those added) with ``n_tokens``, and if asked for ``token_ids`` and digests of
    the ids (``ids_sha256``: decimal, joined by commas) and of the bytes that the ids decode to (``decoded_sha256``).

    Nothing is shuffled. The vocabulary (a few MB, fixed by its file) is broadcast. Input columns that have the name of
    an added column are replaced.
    """
    added = [T.StructField("n_tokens", T.LongType())]
    if ids:
        added.append(T.StructField("token_ids", T.ArrayType(T.IntegerType())))
    if digests:
        added += [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    new = {f.name for f in added}
    keep = [c for c in (df.columns if keep is None else keep) if c not in new]
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    source = df.select(*[f"`{c}`" for c in keep], df[text].alias("__text"))

    def run(batches):
        v = shared.value
        encoder = encoder_of(v)
        for batch in batches:
            for i, data, offsets in chunks(batch.column(len(keep))):
                seq, at = encoder.chunk(data, offsets)
                n = len(at) - 1
                cols = {c: batch.column(k).slice(i, n) for k, c in enumerate(keep)}
                cols["n_tokens"] = pa.array(np.diff(at))
                if ids:
                    cols["token_ids"] = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(seq))
                if digests:
                    text, ends = encoder.decimal(seq, at)
                    size = v.lengths[seq]
                    back, cut = v.decode(seq), np.concatenate(([0], np.cumsum(size)))[at].tolist()
                    text, ends = memoryview(text), ends.tolist()
                    sha = lambda x: hashlib.sha256(x).hexdigest()
                    cols["ids_sha256"] = pa.array([sha(text[a : max(a, b - 1)]) for a, b in zip(ends, ends[1:])], pa.string())
                    back = memoryview(back)
                    cols["decoded_sha256"] = pa.array([sha(back[a:b]) for a, b in zip(cut, cut[1:])], pa.string())
                yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    schema = T.StructType([*(df.schema[c] for c in keep), *added])
    return source.mapInArrow(run, schema)


def decode(df: DataFrame, vocabulary: Vocabulary, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``df`` with the bytes of ``ids`` (null: null) in ``out``, which replaces a column of that name."""
    keep = [c for c in df.columns if c != out]
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        v = shared.value
        for batch in batches:
            lists = batch.column(len(keep))
            seq = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)  # the ids of all rows that are not null
            ends = np.concatenate(([0], np.cumsum(v.lengths[seq])))
            rows = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))))
            at, null = pa.array(ends[rows].astype(np.int64)), pc.is_null(lists).to_numpy(zero_copy_only=False)
            valid = pa.py_buffer(np.packbits(~null, bitorder="little").tobytes())
            made = pa.Array.from_buffers(pa.large_binary(), len(lists), [valid, at.buffers()[1], pa.py_buffer(v.decode(seq))])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], made.cast(pa.binary())], [*keep, out])

    return df.select(*[f"`{c}`" for c in keep], df[ids].alias("__ids")).mapInArrow(run, T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T.BinaryType())]))
