"""The corpus pipeline, stage by stage, against brute force; each stage is judged on what the one before it kept."""

import math
import random
import re
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
from lattica.llm import bpe, mixing, perplexity, queries
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rnd = random.Random(31)
    sounds = {"en": ["the", "an", "ri", "ver", "sto", "ne", "gre", "en", "bri", "dge"], "de": ["ung", "sch", "ein", "keit", "über", "ver", "ge", "ß"]}
    word = lambda lang: "".join(rnd.choice(sounds[lang]) for _ in range(rnd.randint(1, 3)))
    line = lambda lang, n: " ".join(word(lang) for _ in range(n))
    rows = []
    for i in range(160):
        lang = "en" if i % 3 else "de"
        rows.append((i, "\n".join(line(lang, rnd.randint(5, 14)) for _ in range(rnd.randint(3, 12))), lang, rnd.choice(["a", "b", "c", None])))
    banner = [line("en", 9) for _ in range(4)]
    for i in range(200, 212):  # one passage of four lines in many documents
        rows.append((i, "\n".join([line("en", 12), line("en", 11), *banner, line("en", 13), line("en", 10)]), "en", "a"))
    for i in range(300, 330):  # near copies, exact ones among them
        words = rows[i - 300][1].split(" ")
        if i % 3:
            words[rnd.randrange(len(words))] = word("en")
        rows.append((i, " ".join(words), rows[i - 300][2], "b"))
    noise = lambda n: " ".join("".join(rnd.choice("qxzjkvwyfbpg%$") for _ in range(7)) for _ in range(n))
    rows += [(400 + i, noise(60), "en", "c") for i in range(6)] + [(410, line("en", 5), "en", "a"), (411, "one two three four five six seven eight\n" * 9, "en", "a")]
    rows += [(420, None, "en", "a"), (421, "", None, None), (None, rows[7][1], "en", "a"), rows[9], (9, rows[11][1] + " and more of it", "en", "c")]
    return [(*r, len(r[1] or "")) for r in rows]


def base_failed(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    return len(words) < 20 or 100 * len(hit) > 30 * len(words)


def losses(rows):
    """Minus log probability of every code point of each text, by an interpolated Kneser-Ney model in dictionaries."""
    order = perplexity.ORDER
    counts = [Counter() for _ in range(order + 1)]
    for t, lang in rows:
        if not base_failed(t):
            p = "\0" * (order - 1) + t
            counts[order].update((lang, p[k : k + order]) for k in range(len(t)))
    for n in range(order - 1, 0, -1):
        counts[n].update((lang, g[1:]) for lang, g in counts[n + 1])
    total, off, d = [Counter() for _ in counts], [Counter() for _ in counts], [None]
    for n in range(1, order + 1):
        of = Counter(counts[n].values())
        y = of[1] / (of[1] + 2 * of[2]) if of[1] and of[2] else 0.5
        raw = (1 - 2 * y * of[2] / of[1] if of[1] else 0.5, 2 - 3 * y * of[3] / of[2] if of[2] else 1.0, 3 - 4 * y * of[4] / of[3] if of[3] else 1.5)
        d.append([min(max(v, 0.05), i - 0.05) for i, v in enumerate(raw, 1)])
        for (lang, g), c in counts[n].items():
            total[n][lang, g[:-1]] += c
            off[n][lang, g[:-1]] += d[n][min(c, 3) - 1]

    def prob(lang, g):
        if not g:
            return math.exp(perplexity.FLOOR)
        n, h, c = len(g), (lang, g[:-1]), counts[len(g)].get((lang, g), 0)
        if h not in total[n]:
            return prob(lang, g[1:])
        return ((c - d[n][min(c, 3) - 1] if c else 0) + off[n][h] * prob(lang, g[1:])) / total[n][h]

    return [[-math.log(prob(lang, ("\0" * (order - 1) + t)[k : k + order])) for k in range(len(t or ""))] for t, lang in rows]


def verdicts(rows):
    """kept by the base rules and the bands; None where it hangs on less than the width of the histograms' steps."""
    nll, by, out = losses(rows), {}, []
    mean = [sum(x) / max(len(x), 1) for x in nll]
    for i, (t, lang) in enumerate(rows):
        if not base_failed(t):
            by.setdefault(lang, []).append(i)

    def median(values):
        return sorted(values)[(len(values) + 1) // 2 - 1]

    band = {}
    for lang, own in by.items():
        steps = [round(mean[i] * 1000) for i in own]
        mid = median(steps)
        var = sum(sum(v * v for v in nll[i]) - len(nll[i]) * mean[i] ** 2 for i in own)
        band[lang] = mid / 1000, median([abs(s - mid) for s in steps]) / 1000 * 1.4826, var / sum(len(nll[i]) for i in own)
    for i, (t, lang) in enumerate(rows):
        if base_failed(t):
            out.append(False)
            continue
        mid, spread, var = band[lang]
        room, at = math.sqrt(spread**2 + var / len(t)), mean[i] - mid
        edge = min(abs(at + perplexity.LOWER * room), abs(at - perplexity.UPPER * room))
        out.append(None if edge < 0.008 else -perplexity.LOWER * room <= at <= perplexity.UPPER * room)
    return out


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(stage, its rows before and after)."""
    folder, out = tmp_path_factory.mktemp("stages"), []
    docs = spark.createDataFrame(corpus(), SCHEMA).repartition(3)
    docs.write.parquet(f"{folder}/0")
    docs = spark.read.parquet(f"{folder}/0")
    for i, (name, function) in enumerate(corpus_pipeline.STAGES, 1):
        function(spark, docs, "").write.parquet(f"{folder}/{i}")
        after = spark.read.parquet(f"{folder}/{i}")
        out.append((name, docs.collect(), after.collect()))
        assert after.columns[:5] == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
        docs = after
    return out


def test_names(stages):
    assert [s[0] for s in stages] == ["quality rules", "line dedup", "MinHash near-dedup", "mixing sources", "byte-level BPE"] and corpus_pipeline.ORACLE_SQL is None


def test_quality_rules(stages):
    _, before, after = stages[0]
    want = verdicts([(r.text, r.lang) for r in before])
    kept = Counter(map(tuple, after))
    assert kept <= Counter(map(tuple, before))
    for r, verdict in zip(before, want):
        assert verdict is None or (kept[tuple(r)] > 0) == verdict
    assert want.count(None) < 20 and want.count(True) > 120 and not any(400 <= (r.doc_id or 0) < 422 for r in after)


def test_line_dedup(stages):
    _, before, after = stages[1]
    seen, out = set(), {}
    for d, t in sorted({(r.doc_id, r.text) for r in before}, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        lines, hit = t.split("\n"), set()
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            if WORD.search("".join(w)):
                hit |= {i, i + 1, i + 2} if w in seen else set()
                seen.add(w)
        out[d, t] = "\n".join(x for i, x in enumerate(lines) if i not in hit)
    want = Counter((r.doc_id, out[r.doc_id, r.text], r.lang, r.source, len(out[r.doc_id, r.text])) for r in before)
    assert Counter(map(tuple, after)) == want and sum(out[k] != k[1] for k in out) > 10


def test_near_dedup(stages):
    _, before, after = stages[2]

    def shingles(text):
        words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())

    rows = sorted(before, key=lambda r: (r.doc_id is None, r.doc_id or 0))
    sets, group = [shingles(r.text) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for k in range(i):
            if sets[i] and sets[k] and 100 * len(sets[i] & sets[k]) >= 80 * len(sets[i] | sets[k]):
                a, b = sorted((group[i], group[k]))
                group = [a if g == b else g for g in group]
    first = [r for i, r in enumerate(rows) if group[i] == i]
    # of rows with one id and near texts either may stay
    assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in first) and Counter(map(tuple, after)) <= Counter(map(tuple, before))
    assert len(first) < len(rows)


def test_mixing(stages):
    _, before, after = stages[3]
    size = lambda t: len(WORD.findall(t or ""))
    total = {}
    for r in before:
        total[r.source] = total.get(r.source, 0) + size(r.text)
    names = sorted(total, key=lambda s: (s is None, s or ""))
    got = Counter()
    for r in after:
        got[r.source] += size(r.text)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    capped = set()
    while True:  # share what is left by weight until nothing is above three times its size
        left = sum(total.values()) - sum(3 * total[s] for s in capped)
        goal = {s: 3 * total[s] if s in capped else left * weight[s] / sum(weight[x] for x in names if x not in capped) for s in names}
        if not (over := {s for s in names if s not in capped and goal[s] > 3 * total[s]}):
            break
        capped |= over
    assert all(abs(got[s] - goal[s]) <= 2048 + 0.1 * goal[s] and got[s] <= 3 * total[s] for s in names)
    texts = {}
    for r in before:
        texts.setdefault((r.doc_id, r.source), []).append(r.text)
    assert all(any(r.text in t for t in texts[r.doc_id, r.source]) for r in after)  # small texts lie in one block or two


def test_encoding(stages):
    import tiktoken

    _, before, after = stages[4]
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(queries.VOCABULARY), special_tokens={})
    assert Counter(tuple(r)[:5] for r in after) == Counter(map(tuple, before))
    for r in after:
        assert r.token_ids == library.encode_ordinary(r.text or "") and r.n_tokens == len(r.token_ids) and library.decode(r.token_ids) == (r.text or "")


def test_whole_run(spark, tmp_path, stages):
    spark.createDataFrame(corpus(), SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == [*SCHEMA.replace(" long", "").replace(" string", "").split(", "), "n_tokens", "token_ids"]
    assert got.agg(F.sum("n_tokens")).first()[0] > 0 and got.count() >= 100


def test_no_large_plan(spark, tmp_path, monkeypatch):
    """No stage plans all of its tables at once: the driver holds each plan several times, and plans it anew for each of its exchanges."""
    plain, nodes = DataFrameWriter.parquet, {}

    def parquet(self, path, *args, **kw):
        nodes[path] = self._df._jdf.queryExecution().optimizedPlan().toString().count("\n")
        return plain(self, path, *args, **kw)

    spark.createDataFrame(corpus(), SCHEMA).repartition(3).write.parquet(f"{tmp_path}/0")
    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    for i, (_, function) in enumerate(corpus_pipeline.STAGES, 1):
        function(spark, spark.read.parquet(f"{tmp_path}/{i - 1}"), "").write.parquet(f"{tmp_path}/{i}")
    assert len(nodes) > 40 and max(nodes.values()) < 70, {p: n for p, n in nodes.items() if n >= 70}


def test_mix_broadcasts_no_blocks(spark, tmp_path):
    """Taken blocks and buckets grow with the rows and are small as files: their joins are no broadcasts, however small the files."""
    spark.createDataFrame(corpus(), SCHEMA).write.parquet(f"{tmp_path}/0")
    plan = mixing.Mix(spark.read.parquet(f"{tmp_path}/0"), block=8).pieces()._jdf.queryExecution().executedPlan().toString()
    joins = re.findall(r"(\w+Join) \[src#\w+, (b|block)#", plan)
    assert sorted(joins) == [("SortMergeJoin", "b"), ("SortMergeJoin", "block")]
