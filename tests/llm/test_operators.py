"""Edge cases and brute force for the operators of the llm subpackage."""

import hashlib
import math
import random
import re
import struct
import zipfile
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from pyspark.sql import functions as F

from lattica.llm import bpe, bwt_dedup, chat, classifier, line_windows, minhash, mixing, neardup_vectors, perplexity, queries, warc_zip
from lattica.llm.common import components
from lattica.llm.textnp import SPACE, chunks, span_hash, spans

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size int, n_tokens string, spans string, start string"


def fixture(seed=1, n=60):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(2, 7))) for _ in range(400)]
    line = lambda k: " ".join(rnd.choice(vocab) for _ in range(k))
    rows, texts = [], []
    for i in range(n):
        kind = rnd.random()
        if kind < 0.2 and texts:
            t = rnd.choice(texts)
        elif kind < 0.5 and texts:
            words = rnd.choice(texts).split(" ")
            for _ in range(max(1, len(words) // rnd.choice([30, 60, 120]))):
                words[rnd.randrange(len(words))] = rnd.choice(vocab)
            t = " ".join(words)
        else:
            t = "\n".join(line(rnd.randint(3, 14)) for _ in range(rnd.randint(1, 12)))
        texts.append(t)
        rows.append((i, t, rnd.choice(["de", "en", None]), rnd.choice(["a", "b", None]), len(t)))
    shared = line(60)
    rows += [(n + i, f"{line(20)} {shared} {line(20)}", "en", "a", 0) for i in range(4)]
    rows += [(n + 10, None, None, None, None), (n + 11, "", "en", "a", 0), (n + 12, " \n\t ", "en", "a", 0), (n + 13, "A b", "en", "b", 3), (n + 14, "a B", "en", "b", 3),
             (None, texts[0], "en", "a", 1), (3, texts[3], "en", "a", 1), (3, texts[3], "en", "a", 1), (4, "another text with the id four", "en", "a", 1),
             (n + 15, "x" * 5000 + " " + line(2000), "en", "a", 1), (n + 16, "\n".join(["same line of words here"] * 9), "en", "c", 1)]
    return [(*r, "k", 7, "t", "s", "st") for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixture(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def thue_morse(n, letters="ab"):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def roots(nodes, edges):
    up = {i: i for i in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in nodes}


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(50)] + [(100 + i, 101 + i) for i in range(20)] + [(5, None), (7, 7)]
    got = dict(rows_of(components(spark.createDataFrame(edges, "a long, b long"))))
    real = [(a, b) for a, b in edges if b is not None and a != b]
    want = roots({x for e in real for x in e}, real)
    assert got == want


def test_bpe_matches_library(spark, docs, empty):
    import tiktoken

    ranks = bpe.read_ranks(queries.VOCABULARY)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    v = bpe.Vocabulary(ranks, public_tokenizers.PATTERN)
    out = bpe.encode(docs, v, digests=True)
    assert out.columns == [*(c for c in docs.columns if c != "n_tokens"), "n_tokens", "token_ids", "ids_sha256", "decoded_sha256"]
    for r in bpe.decode(out, v).collect():
        want = library.encode_ordinary(r.text or "")
        assert r.token_ids == want and r.n_tokens == len(want) and bytes(r.decoded) == (r.text or "").encode()
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert rows_of(bpe.encode(empty, v)) == []


def test_bpe_pieces_and_long_words():
    import tiktoken

    ranks = bpe.read_ranks(queries.VOCABULARY)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    v, rnd = bpe.Vocabulary(ranks, public_tokenizers.PATTERN), random.Random(5)
    plain = bpe.Vocabulary(ranks, public_tokenizers.PATTERN)
    plain.pieces.fast = False
    letters = list("aab1 s  'tlrevd'' \n\t.é%😀 \x1c日")
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    texts += [t for n in (512, 1024, 2048, 4096, 8192) for t in (thue_morse(n), thue_morse(n, "ba"))]  # equal under any polynomial modulo 2**64
    texts += ["ab" * 3000, "".join(rnd.choice("etaoins") for _ in range(4000)), "a" * 300]
    for vocabulary in (v, plain):
        e, got = bpe.Encoder(vocabulary), []
        for _, data, offsets in chunks(pa.array(texts), 1 << 14):
            ids, at = e.chunk(data, offsets)
            got += [ids[a:b].tolist() for a, b in zip(at, at[1:])]
        assert got == [library.encode_ordinary(t) for t in texts]


def test_hashes_tell_thue_morse_words_apart():
    words = [thue_morse(n, letters) for n in (512, 1024, 2048, 8192) for letters in ("ab", "ba")]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    offsets = np.array([0, len(data)])
    starts, ends, _ = spans(~SPACE[data], offsets)
    assert len(set(span_hash(data, starts, ends).tolist())) == len(words)
    a, b = thue_morse(1024), thue_morse(1024, "ba")
    text = "\n".join([a, b, "one two three"]).encode()
    counts = perplexity.base_counts(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert counts["n_dup_lines"].tolist() == [0]
    pair = [f"{w} one two three four".encode() for w in (a, b)]
    one, two = (minhash.shingle_sets(np.frombuffer(p, np.uint8), np.array([0, len(p)]))[0] for p in pair)
    assert not set(one.tolist()) & set(two.tolist())
    empty = span_hash(data, np.array([3, 3]), np.array([3, 4]))
    assert empty[0] != empty[1] and len(span_hash(data, np.zeros(0, int), np.zeros(0, int))) == 0


def test_mixing(docs, empty, spark):
    got = rows_of(mixing.Mix(docs, block=16).taken())
    assert sorted(map(repr, got)) == sorted(map(repr, rows_of(mixing.Mix(docs.repartition(5), block=16).taken())))
    sizes = sorted((r.doc_id if r.doc_id is not None else -1, len(WORD.findall(r.text or ""))) for r in docs.collect())
    assert sorted((g[0] if g[0] is not None else -1, g[1]) for g in got) == sizes
    assert all(g[4] <= 3 * g[1] for g in got)
    by = {}
    for g in got:
        by.setdefault(g[2:4], [0])[0] += g[4]  # sizes of the sources differ
    assert len(by) == 4 and abs(sum(t for _, t in by) - sum(n for _, n in sizes)) < 1e-6
    for (size, target), (taken,) in by.items():
        assert target <= 3 * size + 1e-9 and abs(taken - target) <= max(64, 0.1 * target)
    assert rows_of(mixing.Mix(empty).taken()) == []
    out = mixing.mix_documents(docs, block=16)
    assert out.columns == docs.columns
    assert sum(len(WORD.findall(r.text)) for r in out.collect()) <= sum(g[4] for g in got)
    assert rows_of(mixing.mix_documents(empty)) == []


def targets(sizes, weights, cap):
    """The fixed point of sharing by weight with caps: sources are capped in the order of cap by weight while the share of the rest is above."""
    left, rest, out = Fraction(sum(sizes)), Fraction(sum(weights)), [0.0] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda i: Fraction(cap * sizes[i], weights[i]))
    for n, i in enumerate(order):
        if left * weights[i] <= cap * sizes[i] * rest:
            for j in order[n:]:
                out[j] = float(left * weights[j] / rest)
            break
        out[i] = float(cap * sizes[i])
        left, rest = left - cap * sizes[i], rest - weights[i]
    return out


def test_targets(spark):
    assert targets([100, 1, 1], [1, 2, 3], 3) == [96.0, 3.0, 3.0]
    rnd = random.Random(3)
    for sizes in ([10, 10, 10], [100, 1, 1], [0, 5], [0, 0], [int(10 ** rnd.uniform(0, 5)) for _ in range(200)], [3**i for i in range(12)]):
        weights = [(1, 2, 3)[i % 3] for i in range(len(sizes))]
        df = spark.createDataFrame([(i, n, w) for i, (n, w) in enumerate(zip(sizes, weights))], "src long, source_size long, weight long")
        got = [r.target for r in mixing.capped(df, 3).orderBy("src").collect()]
        assert np.allclose(got, targets(sizes, weights, 3), rtol=1e-12)
    assert mixing.capped(spark.createDataFrame([], "src long, source_size long, weight long"), 3).collect() == []


def test_mixing_against_brute_force(spark):
    """Word by word: targets, packing, the balance of blocks and what is taken, for more sources than fit in a list, with repeated rows."""
    rnd = random.Random(17)
    text = lambda n: " ".join(f"w{rnd.randrange(99)}" for _ in range(n))
    rows = [(i, text(rnd.randint(0, 60)), f"h{rnd.randrange(11_000)}") for i in range(12_000)]
    rows += [(i, text(rnd.randint(0, 300)), "hot") for i in range(20_000, 21_500)] + [(30_000, "a b c " * 40, "hot")] * 5 + [(None, text(50), None), (1, None, "h1"), (2, " \n", "z")]
    mix = mixing.Mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3), block=8, slots=512)
    got = mix.taken().collect()
    size = lambda t: len(WORD.findall(t or ""))
    total = {}
    for _, t, s in rows:
        total[s] = total.get(s, 0) + size(t)
    names = sorted(total, key=lambda s: (s is None, s or ""))
    assert len(names) > 7_000
    goal = dict(zip(names, targets([total[s] for s in names], [(1, 2, 3)[i % 3] for i in range(len(names))], 3)))
    sources = {r.src: (r["__source"], r.source_size, r.target) for r in mix.sources.collect()}
    assert [sources[i][0] for i in range(len(names))] == names
    assert all(n == total[s] and abs(t - goal[s]) <= 1e-9 * max(1, goal[s]) for s, n, t in sources.values())
    copies = {(r.src, r.block): r.copies for r in mix.used(spark).collect()}
    first = {(r.src, r.b): r["first"] for r in mix.offsets.collect()}
    want, blocks, place = {}, {}, {}
    for r in mix.placed.collect():
        place[r["__row"]] = r
        taken = 0
        for w in range(r.start, r.start + r.size):
            block = first[r.src, r.b] + w // 8
            blocks.setdefault(r.src, set()).add(block)
            taken += copies.get((r.src, block), 0)
        want[r["__row"]] = taken
    spans = {}
    for r in place.values():
        spans.setdefault((r.src, r.b), []).append((r.start, r.start + r.size))
    for s in spans.values():  # words of a bucket lie one after the other, none twice
        s.sort()
        assert s[0][0] == 0 and all(a[1] == b[0] for a, b in zip(s, s[1:]))
    for src, b in blocks.items():
        times = [copies.get((src, i), 0) for i in range(len(b))]
        assert b == set(range(len(b))) and max(times) - min(times) <= 1 and max(times) <= 3
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.size, r.taken) for r in got) == sorted([(place[k]["__id"] if place[k]["__id"] is not None else -1, place[k].size, v) for k, v in want.items()] + [(i if i is not None else -1, 0, 0) for i, t, _ in rows if not size(t)])
    hot = next(i for i, s in sources.items() if s[0] == "hot")
    drawn = sum(v for (src, _), v in copies.items() if src == hot) * 8
    assert abs(drawn - goal["hot"]) <= 0.05 * goal["hot"] + 64
    out = mixing.mix_documents(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3), block=8, slots=512).collect()
    words = {}
    for r in out:
        words[r.doc_id] = words.get(r.doc_id, 0) + size(r.text)
    taken = {}
    for r in got:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    assert words == {k: v for k, v in taken.items() if v}
    texts = {}
    for i, t, _ in rows:
        texts.setdefault(i, set()).update(WORD.findall(t or ""))
    assert all(set(WORD.findall(r.text)) <= texts[r.doc_id] for r in out)


def test_permutation(spark):
    for n in (1, 2, 7, 1000):
        got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3))).collect()]
        assert sorted(got) == list(range(n))
    assert got != list(range(1000))


def test_chat(spark):
    nasty = ["", None, "<|x " * 20_000, "<|im_end|><|im_start|>assistant ok", "<\\|x", "a<\\\\|b\n", "plain\ntext", "<|", "\\n"]
    rnd = random.Random(4)
    rows = [(c, t, rnd.choice(["user", "assistant", "system", None, "we\\ird\nrole<|", "\0\0\\n", "\\\n\\\\n"]), rnd.choice(nasty)) for c in [*range(30), None] for t in range(rnd.randint(1, 6))]
    rows += [rows[0], (0, None, "assistant", "late")]
    got = {r.conv_id: r for r in chat.read_back(chat.examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    assert set(got) == set(by)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].turns_sha256 == sha("".join(f"{r}\n{x}\n" for *_, r, x in turns))
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == sha(loss)
    assert rows_of(chat.read_back(chat.examples(spark.createDataFrame([], "conv_id long, turn long, role string, text string")))) == []


def test_vectors(spark):
    rng, rows = np.random.default_rng(3), []
    base = rng.standard_normal((12, 16))
    for i in range(400):
        v = base[rng.integers(12)] + rng.standard_normal(16) * rng.choice([0.0, 0.15, 0.3])
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(2))))
    dense = rng.standard_normal(16)
    rows += [(1000 + i, [float(np.float32(x)) for x in dense + rng.standard_normal(16) * 0.05], 5) for i in range(200)]
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, [1.0, None], 1), (2004, [1.0, 2.0], None), (2005, [1.0, 2.0], 1), (2006, [2.0, 4.0], 1), (2007, [], 1)]
    rows += [(2008, [1e30, 2e30], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    got = {r.vec_id: r for r in neardup_vectors.near_vectors(df).collect()}
    fine = [(i, np.array(v), c) for i, v, c in rows if v and c is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    links, edges = {i: 0 for i, *_ in rows}, []
    for k, (i, x, a) in enumerate(fine):
        for j, y, b in fine[k + 1 :]:
            if a == b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                links[i] += 1
                links[j] += 1
                edges.append((i, j))
    want = roots(links, edges)
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {i: (links[i], want[i], want[i] == i) for i in links}
    assert rows_of(neardup_vectors.near_vectors(df.limit(0))) == []
    # ids that repeat or are null, and columns of the operator's own names
    odd = [(7, [1.0, 2.0], 1, "x", 0.5), (7, [1.0, 2.001], 1, "y", 0.5), (None, [1.0, 2.0], 1, "z", 0.5), (9, [-2.0, 1.0], 1, None, None), (9, [1e300, 2e300], 1, "x", 0.5)]
    got = neardup_vectors.near_vectors(spark.createDataFrame(odd, "vec_id long, embedding array<double>, label int, node string, dim double"))
    assert sorted(map(repr, rows_of(got))) == sorted(map(repr, [(7, 3, 7, True), (7, 3, 7, True), (None, 3, 7, None), (9, 0, 9, True), (9, 3, 7, False)]))


def test_vectors_that_point_the_same_way(spark):
    """Planted pairs at the bound in a label of typical cosine 0.88, against all pairs."""
    rng, dim = np.random.default_rng(5), 32
    unit = lambda v: v / np.sqrt((v * v).sum(-1, keepdims=True))
    x = unit(np.sqrt(0.88) * unit(rng.standard_normal(dim)) + np.sqrt(0.12) * unit(rng.standard_normal((3000, dim))))
    step = rng.standard_normal((100, dim))
    step -= (step * x[:100]).sum(1)[:, None] * x[:100]
    y = 0.94 * x[:100] + np.sqrt(1 - 0.94**2) * unit(step)
    x = np.concatenate((x, y))
    cosines = x @ x.T
    np.fill_diagonal(cosines, 0)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in neardup_vectors.near_vectors(df).collect()}
    a, b = np.nonzero(cosines >= 0.93)
    want = roots(range(len(x)), list(zip(a.tolist(), b.tolist())))
    links = (cosines >= 0.93).sum(1)
    assert got == {i: (links[i], want[i]) for i in range(len(x))}
    # a large label goes by passes, as many as its spread asks for
    assert 0 < neardup_vectors.passes_for(10**6, 0.93) < neardup_vectors.passes_for(10**6, 0.93, 0.3)


def links_of(x, bound=0.93):
    x = x / np.sqrt((x * x).sum(1))[:, None]
    hit = x @ x.T >= bound
    np.fill_diagonal(hit, False)
    a, b = np.nonzero(hit)
    return hit.sum(1), roots(range(len(x)), list(zip(a.tolist(), b.tolist())))


@pytest.mark.parametrize("mean, partitions", [(0.87, 4), (0.885, 31), (0.0, 3), (0.5, 31)])
def test_vectors_lose_no_link(spark, mean, partitions):
    """Groups around one centre and spread ones, with planted pairs at the bound, equal all pairs at any number of partitions."""
    rng, n, dim = np.random.default_rng(7), 3000, 64
    unit = lambda v: v / np.sqrt((v * v).sum(-1, keepdims=True))
    x = unit(np.sqrt(mean) * unit(rng.standard_normal(dim)) + np.sqrt(1 - mean) * unit(rng.standard_normal((n, dim))))
    step = rng.standard_normal((200, dim))
    step -= (step * x[:200]).sum(1)[:, None] * x[:200]
    x = np.concatenate((x, 0.935 * x[:200] + np.sqrt(1 - 0.935**2) * unit(step))).astype(np.float32)
    links, want = links_of(x.astype(np.float64))
    assert links.sum() >= 300
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
        got = {r.vec_id: (r.n_links, r.component_id) for r in neardup_vectors.near_vectors(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == {i: (links[i], want[i]) for i in range(len(x))}


def test_passes_settle_spread_labels(spark):
    """Spread vectors are settled by their passes; those of a dense group in the same label, and only those, are open."""
    rng, dim = np.random.default_rng(8), 64
    x = np.concatenate((rng.standard_normal((4000, dim)), rng.standard_normal(dim) + 0.2 * rng.standard_normal((400, dim))))
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    ready = neardup_vectors._prepared(df).select("label", "dim", "vec", F.col("vec_id").alias("node"))
    found = neardup_vectors.written(neardup_vectors._passes(neardup_vectors._centred(ready, 0.93), 0.93, 7), "found")
    some = found.where("kind <> 2").select("kind", "a", "b", "score").unionByName(neardup_vectors._borders(found, 0.93))
    scores = dict(rows_of(some.where("kind = 1").groupBy("a").agg(F.sum("score"))))
    opened = {i for i in range(len(x)) if scores.get(i, 0.0) > np.log(neardup_vectors.MISS)}
    assert len([i for i in opened if i < 4000]) < 400 and all(found.groupBy("kind").count().collect())
    credits = rows_of(some.where("kind = 1").groupBy("a").count())
    assert {c for _, c in credits} == {neardup_vectors.passes_for(len(x), 0.93, 1 - float((np.square((x / np.sqrt((x * x).sum(1))[:, None]).mean(0))).sum()))}


def test_zip_reader_against_library(tmp_path):
    blobs = {"a.txt": b"hello", warc_zip.DATA: bytes(range(256)) * 50, "d/é": b""}
    for kind in ("library", "plain", "zip64"):
        path = tmp_path / f"{kind}.zip"
        if kind == "library":
            with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
                z.comment = b"PK\5\6 in a comment"
                for k, v in blobs.items():
                    z.writestr(k, v)
        else:
            with open(path, "wb") as f:
                z = warc_zip.ZipWriter(f, kind == "zip64")
                for k, v in blobs.items():
                    z.member(k, iter([v]), len(v), zlib.crc32(v))
                z.close()
            with zipfile.ZipFile(path) as z:
                assert {k: z.read(k) for k in z.namelist()} == blobs and z.testzip() is None
        raw = path.read_bytes()
        found = warc_zip.members(lambda o, n: raw[o : o + n], len(raw))
        assert {k: raw[o : o + n] for k, (m, o, n) in found.items()} == blobs
    with pytest.raises((ValueError, struct.error)):
        warc_zip.members(lambda o, n: b"x" * n, 100)


@pytest.mark.parametrize("zip64", [False, True])
def test_archives(spark, zip64):
    big, rows = "payload " * 20, []
    rows = [(5, "u", big, 1), (2, None, big, 1), (9, "http://x\r\ny", big, 1), (3, "u", "short", 1), (4, "u", "short", 1), (6, "u", None, 1), (None, "u", "é" * 80, 1), (7, "u", "é" * 80, 1), (8, "u", "\r\n\r\nWARC/1.1" * 30, 1), (8, "u", "\r\n\r\nWARC/1.1" * 30, 1)]
    got = warc_zip.archive_and_read(spark.createDataFrame(rows, "page_id long, url string, html string, payload_bytes int").repartition(3), zip64).drop("payload", "url")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for p, _, html, _ in rows:
        html = html or ""
        same = [q for q, _, h, _ in rows if h == html and q is not None]
        revisit = len(html.encode()) >= 100 and min(same) != p
        want.append((p, len(html.encode()), sha(html), "revisit" if revisit else "response", min(same) if revisit else None))
    assert sorted(map(repr, rows_of(got))) == sorted(map(repr, want))
    assert rows_of(warc_zip.archive_and_read(spark.createDataFrame([], "page_id long, url string, html string"))) == []


def test_base_rules(docs, empty):
    def brute(text):
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        hit = set()
        for i, w in enumerate(windows):
            if windows.count(w) > 1:
                hit |= set(range(i, i + 8))
        return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)

    for r in perplexity.judge(docs, keep=["doc_id", "text", "size", "kept"]).collect():
        want = brute(r.text or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and (not r.base_failed or r.kept is False) and r.size == 7
    kept = perplexity.filter_kept(docs)
    assert kept.columns == docs.columns and kept.count() > 0
    assert rows_of(perplexity.judge(empty)) == [] and rows_of(perplexity.filter_kept(empty)) == []


def test_perplexity_model_is_a_distribution_and_finds_noise(spark):
    rnd = random.Random(8)
    clean = [(i, " ".join(rnd.choice(["river", "stone", "green", "valley", "under", "bridge"]) for _ in range(rnd.randint(40, 200))), "en") for i in range(150)]
    noise = [(1000, " ".join("".join(rnd.choice("qxzjkvwyfbpg") for _ in range(6)) for _ in range(100)), "en")]
    df = spark.createDataFrame(clean + noise, "doc_id long, text string, lang string")
    model = perplexity.train(df)
    lang = perplexity.lang_hashes(["en"])
    letters = sorted({c for _, t, _ in clean + noise for c in t})
    for history in ("", "r", "riv", "the green val", "zzz"):
        total = 0.0
        for c in letters:
            data = np.frombuffer((history + c).encode(), np.uint8)
            points, at = perplexity.code_points(data, np.array([0, len(data)]))
            total += np.exp(-model.nll(points, at, lang)[-1])
        assert 0.9 < total < 1.05
    kept = {r.doc_id: r.kept for r in perplexity.judge(df, keep=["doc_id"]).collect()}
    assert not kept[1000] and sum(kept.values()) >= 145


def test_model_keeps_every_ngram(spark):
    """Perplexities against a model in dictionaries, over so many distinct n-grams that a table of 2**20 hashes would mix some."""
    rnd, order = random.Random(9), perplexity.ORDER
    words = lambda k, first, n: " ".join("".join(chr(first + rnd.randrange(n)) for _ in range(4)) for _ in range(k))
    rows = [(i, words(40, 0x4E00, 6000), "zh") for i in range(150)] + [(200 + i, words(30, 97, 20), None) for i in range(20)]
    rows += [(300, words(10, 0x4E00, 6000), "zh"), (301, words(5, 0x6000, 4000) + "\U0001F600", None), (302, None, "zh"), (303, "", None)]
    counts = [{} for _ in range(order + 1)]
    padded = {i: "\0" * (order - 1) + (t or "") for i, t, _ in rows}
    for i, t, lang in rows:
        for k in range(len(t or "") if i < 300 else 0):
            g = (lang, padded[i][k : k + order])
            counts[order][g] = counts[order].get(g, 0) + 1
    for n in range(order - 1, 0, -1):
        for lang, g in counts[n + 1]:
            counts[n][lang, g[1:]] = counts[n].get((lang, g[1:]), 0) + 1
    total, off, discounts = [{} for _ in counts], [{} for _ in counts], [None]
    for n in range(1, order + 1):
        n1, n2, n3, n4 = (sum(c == k for c in counts[n].values()) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        raw = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
        discounts.append([min(max(v, 0.05), i - 0.05) for i, v in enumerate(raw, 1)])
        for (lang, g), c in counts[n].items():
            h = lang, g[:-1]
            total[n][h] = total[n].get(h, 0) + c
            off[n][h] = off[n].get(h, 0) + discounts[n][min(c, 3) - 1]

    def prob(lang, g):
        if not g:
            return np.exp(perplexity.FLOOR)
        n, h, c = len(g), (lang, g[:-1]), counts[len(g)].get((lang, g), 0)
        if h not in total[n]:
            return prob(lang, g[1:])
        return ((c - discounts[n][min(c, 3) - 1] if c else 0) + off[n][h] * prob(lang, g[1:])) / total[n][h]

    got = {r.doc_id: r.perplexity for r in perplexity.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2), keep=["doc_id"]).collect()}
    assert set(got) == {r[0] for r in rows} and len(counts[order]) > 25_000
    for i, t, lang in rows:
        want = np.exp(-np.mean([np.log(prob(lang, padded[i][k : k + order])) for k in range(len(t))])) if t else 1.0
        assert abs(got[i] - want) <= 1e-6 * want, i


def test_bands_reject_what_labels_call_junk(spark):
    """Texts at moderate distance from the median, where junk lies, are rejected on either side; those nearer are kept."""
    spread = 0.05 * 1.4826
    far = {1000: 2.2, 1001: 2.8, 1002: -1.8, 1003: -2.3}
    rows = [(i, "=en", 2 + 0.002 * (i - 50)) for i in range(101)] + [(i, "=en", 2 + w * spread) for i, w in far.items()]
    judged = spark.createDataFrame([(i, k, v, v * v, 1000.0, False) for i, k, v in rows], "doc_id long, __key string, __nll double, __nll2 double, __n double, base_failed boolean")
    kept = {r.doc_id: r.kept for r in perplexity._held(judged).collect()}
    assert {i: kept[i] for i in far} == {1000: True, 1001: False, 1002: True, 1003: False} and all(kept[i] for i in range(101))


def test_line_windows(docs, empty):
    out = {}
    seen, gone = set(), {}
    rows = {(r.doc_id, r.text) for r in docs.collect() if r.text is not None}
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        lines = t.split("\n")
        hit = set()
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            if WORD.search("".join(w)):
                if w in seen:
                    hit |= {i, i + 1, i + 2}
                seen.add(w)
        out[d, t] = "\n".join(x for i, x in enumerate(lines) if i not in hit)
        gone[d, t] = len(hit)
    got = line_windows.dedup_lines(docs, counts=True)
    pairs = sorted((repr((r.doc_id, r.text)), r.n_removed) for r in got.collect())
    assert pairs == sorted((repr((r.doc_id, out.get((r.doc_id, r.text)))), gone.get((r.doc_id, r.text), 0)) for r in docs.collect())
    assert line_windows.dedup_lines(docs).columns == docs.columns
    assert rows_of(line_windows.dedup_lines(empty)) == []


def test_minhash(docs, empty):
    def shingles(text):
        words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())

    rows = [r for r in docs.collect() if not (r.doc_id == 4 and r.text.startswith("another"))]  # an id with two texts is tested apart
    sets = {r.doc_id: shingles(r.text) for r in rows if r.doc_id is not None}
    ids = sorted(sets)
    edges = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = roots(ids, edges)
    some = docs.where("not (doc_id <=> 4 and text like 'another%')")
    got = minhash.near_duplicates(some).collect()
    assert len(got) == len(rows) and len(edges) > 5
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept is None
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
    kept = minhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} >= {i for i in ids if want[i] == i}
    assert minhash.near_duplicates(docs).count() == docs.count()
    assert rows_of(minhash.near_duplicates(empty)) == [] and rows_of(minhash.keep_first(empty)) == []


def test_first_of_each_group_is_kept_whatever_the_ids(spark):
    rnd = random.Random(12)
    text = lambda: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(60))
    near = lambda t: " ".join([*t.split()[:-1], "other"])
    a, b, c, d = text(), text(), text(), text()
    rows = [(1, a), (2, near(a)), (2, b), (None, c), (None, near(c)), (None, c), (5, near(c)), (7, d), (7, d), (8, None), (8, None), (None, "")]
    got = minhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [(1, a), (2, b), (5, near(c)), (7, d), (8, None), (8, None), (None, "")]))


def test_template_family_makes_no_pairs(spark, monkeypatch):
    """One text with nine words changed in each copy: buckets are shared by all, but the pairs that are looked at grow with the copies."""
    rnd, seen = random.Random(13), []
    base = [f"w{i}" for i in range(400)]
    keep = minhash.written
    monkeypatch.setattr(minhash, "written", lambda df, name: seen.append((name, out := keep(df, name))) or out)
    for n in (150, 600):
        rows = []
        for i in range(n):
            words = list(base)
            for at in rnd.sample(range(400), 9):
                words[at] = f"x{rnd.randrange(10**9)}"
            rows.append((i, " ".join(words)))
        rows += [(n, rows[7][1] + " and more"), (n + 1, " ".join([*rows[9][1].split()[:395], "other", "end"]))]
        seen.clear()
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        sets = {i: frozenset(zip(*(t.split()[k:] for k in range(5)))) for i, t in rows}
        edges = [(x, y) for x in sets for y in sets if x < y and 100 * len(sets[x] & sets[y]) >= 85 * len(sets[x] | sets[y])]
        assert got == roots(sorted(sets), edges) and len(edges) >= 2
        listed = next(df for name, df in seen if name == "differences")
        met = listed.where("rank <= low").groupBy("hub", "shingle").count().join(listed.where("rank <= high").groupBy("hub", "shingle").agg(F.count("*").alias("m")), ["hub", "shingle"])
        assert (met.agg(F.sum(F.col("count") * F.col("m"))).first()[0] or 0) <= 20 * n
    monkeypatch.undo()


def test_pipeline_drops_near_copies_at_80_percent(spark):
    """The pipeline's stage against brute force on texts whose similarities lie around 0.8."""
    import corpus_pipeline

    rnd, rows = random.Random(11), []
    for g in range(20):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(120)]
        rows.append((10 * g, " ".join(base)))
        for i in range(1, 4):  # k changed words at the end leave 116 - k of 116 + k shingles
            k = rnd.randint(8, 17)
            rows.append((10 * g + i, " ".join([*base[: 120 - k], *(f"x{rnd.randrange(10**6)}" for _ in range(k))])))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(116)} for i, t in rows}
    ids = sorted(sets)
    pairs = [(a, b, len(sets[a] & sets[b]) / len(sets[a] | sets[b])) for k, a in enumerate(ids) for b in ids[k + 1 :]]
    want = roots(ids, [(a, b) for a, b, j in pairs if j >= 0.8])
    assert sum(0.8 <= j < 0.85 for *_, j in pairs) > 10 and sum(0.7 < j < 0.8 for *_, j in pairs) > 10
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in got.collect()) == [i for i in ids if want[i] == i]
    assert (1 - 0.8**minhash.ROWS) ** minhash.bands_for(80) <= 1e-6 and minhash.bands_for(85) == minhash.BANDS == 25


def test_densification_agrees_with_similarity():
    rng = np.random.default_rng(1)
    for n in (3, 20, 200, 2000):
        base = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
        a, b = np.sort(base[: int(1.8 * n)]), np.sort(base[int(0.2 * n) :])
        hashes, at = np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)])
        sig = minhash.signatures(hashes, at)
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((sig[0] == sig[1]).mean() - true) < 0.35


def later_bytes(rows):
    """What operator 10 returns of each (doc_id, text), by a set of all strings of 100 bytes."""
    seen, want = set(), {}
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        x = (t or "").encode()
        gone = np.zeros(len(x), bool)
        for s in range(len(x) - 99):
            if x[s : s + 100] in seen:
                gone[s : s + 100] = True
            seen.add(x[s : s + 100])
        want[d, t] = (len(x), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(np.frombuffer(x, np.uint8)[~gone].tobytes()).hexdigest())
    return want


def test_hot_anchors_are_split(spark, monkeypatch):
    """One passage in most documents, each time in another context: its rim's anchors are dealt to many keys of bounded size."""
    rnd, rows = random.Random(21), []
    word = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    passage, few = word(230), [word(9) for _ in range(12)]
    for i in range(300):
        # a few contexts beside the passage are shared, so strings over the rim repeat as well
        rows.append((i, word(rnd.randint(30, 90)) + rnd.choice(few) + passage + rnd.choice(few) + word(rnd.randint(30, 90))))
    rows += [(400, rows[3][1][:150] + word(50)), (401, rows[5][1]), (None, rows[6][1]), (402, None)]
    monkeypatch.setattr(bwt_dedup, "HOT", 4000)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(repr, rows_of(bwt_dedup.dedup_bytes(df))))
    want = later_bytes(set(rows))
    assert got == sorted(repr((d, *want[d, t])) for d, t in rows)
    copies, firsts = bwt_dedup.removed(bwt_dedup.keyed(df))
    assert len(firsts) > 1
    sizes = [t.groupBy("a").agg(F.sum("len").alias("n")).agg(F.max("n")).first()[0] or 0 for t in firsts]
    assert max(sizes) <= 4000


def test_bwt(docs, empty):
    rnd = random.Random(3)
    for _ in range(100):
        x = bytes(rnd.choice(b"ab") for _ in range(rnd.randint(5, 60))) * rnd.randint(1, 4)
        length = rnd.randint(2, 12)
        order, first = bwt_dedup.shared_prefixes(np.frombuffer(x, np.uint8), length)
        y = x + b"\xff" * length
        assert sorted(range(len(y) + 1), key=lambda i: y[i:]) == order.tolist() or length < len(y)
        for k in range(1, len(order)):
            p, q = y[order[k - 1] :], y[order[k] :]
            shared = next((i for i, (a, b) in enumerate(zip(p, q)) if a != b), min(len(p), len(q)))
            assert (shared < length) == bool(first[k])
    rows = {(r.doc_id, r.text) for r in docs.collect()}
    ids, want = [d for d, _ in rows], later_bytes(rows)
    got = sorted(repr(r) for r in rows_of(bwt_dedup.dedup_bytes(docs)))
    assert ids.count(4) == 2
    assert got == sorted(repr((r.doc_id, *want[r.doc_id, r.text])) for r in docs.collect())
    assert rows_of(bwt_dedup.dedup_bytes(empty)) == []


def test_resampling(spark):
    rnd = random.Random(6)
    good, bad = [f"good{i}" for i in range(200)], [f"bad{i}" for i in range(200)]
    rows = [(i, " ".join(rnd.choice(good if i % 4 else bad) for _ in range(80))) for i in range(400)]
    labels = [(i, int(i % 4 > 0), 0) for i in range(200)] + [(None, 1, 0), (5000, None, 1)]
    docs = spark.createDataFrame([*rows, (None, None), (900, "")], "doc_id long, text string")
    got = classifier.resample(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    held = [(r.kept, r.doc_id % 4 > 0) for r in got if r.doc_id is not None and r.doc_id < 400]
    assert sum(a == b for a, b in held) >= 0.97 * len(held) and len(got) == 402
    assert all(r.kept for r in classifier.resample(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect())
    assert rows_of(classifier.resample(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))) == []


def test_resampling_against_brute_force(spark):
    """Weights from counts in dictionaries, the cut and the k-th value by sorting; with ties, repeated rows, long texts and clashing columns."""
    rnd = random.Random(16)
    vocab = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rnd.choice(vocab[: 40 + 20 * (i % 3 == 0)]) + rnd.choice(["", ".", "?!"]) for _ in range(rnd.randint(1, 120))), "h", 1.5) for i in range(200)]
    rows += [(300, "w1 W2, w59 " * 5000, None, 0.0), (301, None, "x", 0.0), (None, "w1 w2", "x", 0.0), (302, " ", None, None), *[(303, "w3 w59 w3", "x", 1.0)] * 4]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h string, value double").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(150)], "doc_id long, quality int, toxic int")
    fit = {r[0] for r in labels.where("quality = 1 and xxhash64(1, 2, doc_id) % 2 = 0").select("doc_id").collect()}

    def grams(text):
        words = [w.lower() for w in WORD.findall(text or "")]
        words = [w[: max(1, len(w.rstrip(".,;:!?")))] for w in words]
        return [(w,) for w in words] + list(zip(words, words[1:]))

    def bucket(gram, known={}):
        if gram not in known:
            data = np.frombuffer(" ".join(gram).encode(), np.uint8)
            known[gram] = int(classifier.features(data, np.array([0, len(data)]))[0][len(gram) - 1 if len(gram) == 1 else -1])
        return known[gram]

    raw, target = {}, {}
    for i, text, *_ in rows:
        for g in grams(text):
            raw[bucket(g)] = raw.get(bucket(g), 0) + 1
            if i in fit:
                target[bucket(g)] = target.get(bucket(g), 0) + 1
    share = sum(target.values()) / sum(raw.values())

    def weight(text):
        found = [bucket(g) for g in grams(text)]

        def ratio(b):
            e = raw[b] * share
            r = math.log((target.get(b, 0) + classifier.PRIOR) / (e + classifier.PRIOR))
            return math.copysign(max(abs(r) - classifier.DRIFT, 0.0), r) * e / (e + classifier.EVIDENCE)

        return sum(map(ratio, found)) * (classifier.LENGTH / max(len(found), 1)) ** 0.5

    got = classifier.resample(docs, labels).collect()
    want = {(i, round(weight(t), 4)) for i, t, *_ in rows}
    assert len(got) == len(rows) and {(r.doc_id, round(r.log_weight, 4)) for r in got} == want
    assert 0 < sum(r.kept for r in got) < len(rows)
    for k in (1, 7, 100, 10_000):
        some = classifier.resample(docs, labels, k=k).collect()
        assert min(k, len(rows)) <= sum(r.kept for r in some) <= min(k, len(rows)) + 3  # the four equal rows tie
    values = [rnd.choice([0.0, 1.0, -3.5, rnd.gauss(0, 1) ** 9]) for _ in range(30_000)]
    df = spark.createDataFrame([(v,) for v in values], "value double")
    ordered = sorted(values, reverse=True)
    assert all(classifier.kth_largest(df, k) == ordered[k - 1] for k in (1, 9_000, 15_000, 29_999, 30_000)) and classifier.kth_largest(df, 30_001) is None
