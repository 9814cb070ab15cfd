"""Spelling variants, the backoff automaton and whitening against brute force."""

import gc
import math
import re
import zlib
from collections import Counter, defaultdict
from unittest import mock

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from biomeframe.llm import lm, spelling, whiten
from biomeframe.llm.common import held_out


def trained():
    return ~held_out("doc_id", 1)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


# ---------------------------------------------------------------- spelling


def brute_near(counts):
    near, holes = defaultdict(set), defaultdict(list)
    for w in counts:
        for i in range(len(w)):
            holes[w[:i], w[i + 1 :]].append(w)
            less = w[:i] + w[i + 1 :]
            if less in counts:
                near[w].add(less)
                near[less].add(w)
    for group in holes.values():
        for w in group:
            near[w].update(x for x in group if x != w)
    return near


def brute_variants(counts, times=10):
    near, out, form = brute_near(counts), {}, {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x)) if near[w] else None
        form[w] = best if best and counts[best] >= times * n else None
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None)
    return out


def random_words(rng, n, letters, low, high):
    words = {"".join(rng.choice(list(letters), rng.integers(low, high + 1))) for _ in range(n)}
    return {str(w): int(rng.integers(1, 4) * 10 ** rng.integers(0, 4)) for w in words}


@pytest.mark.parametrize("grouping", [{}, {"group_chars": 400, "group_rows": 1000}, {"group_chars": 300, "group_rows": 12}])
def test_variants_equal_brute_force(spark, grouping):
    rng = np.random.default_rng(8)
    counts = random_words(rng, 400, "ab", 2, 9) | random_words(rng, 300, "abcé", 3, 5)
    counts |= {f"same{x}{y}": 3 for x in "abcdefg" for y in "uvwxyz"} | {"mama": 9, "mamama": 90, "mamamama": 2}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r["word"]: tuple(r) for r in spelling.variants(words, **grouping).collect()}
    assert got == brute_variants(counts)


def test_search_finds_each_half_apart():
    rng = np.random.default_rng(2)
    counts = random_words(rng, 250, "abc", 4, 6)
    names = sorted(counts)
    index = spelling.Index(names)
    near = brute_near(counts)
    for first in (True, False):
        q, hits = spelling.search(index, names, first)
        want = set()
        for w in names:
            half = len(w) // 2
            for x in near[w]:
                if len(x) >= len(w) and (x.startswith(w[:half]) if first else x.endswith(w[half:])):
                    want.add((w, x))
        assert {(names[a], names[b]) for a, b in zip(q, hits, strict=True)} == want
        assert len(q) == len(want)


def test_suffix_order_and_sparse_ranks(monkeypatch):
    monkeypatch.setattr(spelling, "TABLE_CELLS", 60)  # counts of every 20th place only
    words = ["abab", "ababab", "a", "b" * 40, "b" * 41]
    index = spelling.Index(words)
    text = "\n" + "".join(w + "\n" for w in words)
    assert index.ways[0].order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    assert index.ways[0].step > 1
    for at in range(len(text) + 1):
        row = index.ways[0].rows(np.array([at]))[0]
        before = [text[i - 1] for i in index.ways[0].order[:at]]
        assert row[1] == before.count("\n") and row.sum() == at
    q, hits = spelling.search(index, words, True)
    assert [(words[a], words[b]) for a, b in zip(q, hits, strict=True)] == [("b" * 40, "b" * 41)]


def test_runs_lose_a_code_point_by_hash(spark):
    texts = ["Wörterbuch wörterbuch, ÄPFELKISTE x÷y naïveté1overlooked", "", None] + [f"lettering{'x' * (i % 5)} other{i}" for i in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "abcdefgh abcdefgh")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit(1))
    want = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                want[run] += 1
    got = spelling.vocabulary(spelling.runs(docs), 1).collect()
    assert {r["word"]: r["n"] for r in got} == want
    assert {r["word"] for r in spelling.vocabulary(spelling.runs(docs)).collect()} == {w for w, n in want.items() if n >= 2}


def test_variant_edge_cases(spark):
    long = "q" * 20_000
    rows = [(long, 1), (long + "r", 20), (None, 5), ("", 4), ("a", 1), ("b", 70), ("tester", None), ("gelbes", 1), ("gelbes", 2), ("gelbe", 30), ("gelber", 30)]
    words = spark.createDataFrame(rows, "word string, n long").withColumn("form", F.lit("x")).withColumn("first", F.lit(1))
    got = {r["word"]: tuple(r)[1:] for r in spelling.variants(words).collect()}
    assert got.pop(long) == (long + "r", long + "r", 1, 1, 20) and got.pop(long + "r") == (None, long + "r", 20, 1, None)
    # Of equal numbers the smaller word; single letters are near each other.
    assert got["gelbes"] == ("gelbe", "gelbe", 3, 2, 30)
    assert got["a"] == ("b", "b", 1, 1, 70) and set(got) == {"a", "b", "gelbes", "gelbe", "gelber"}
    assert spelling.variants(words.limit(0)).count() == 0


# ---------------------------------------------------------------- automaton


def brute_scores(rows, order, strength):
    sequences = [["<s>", *re.findall(r"[^\x20\x09-\x0D]+", lower(t or "")), "</s>"] for _, t in rows]
    training = [zlib.crc32(str("" if i is None else i).encode()) % 5 != 1 for i, _ in rows]
    counts = Counter()
    for s, train in zip(sequences, training, strict=True):
        if train:
            counts.update(tuple(s[a : a + m]) for m in range(1, order + 1) for a in range(len(s) - m + 1))
    single = {g[0]: n for g, n in counts.items() if len(g) == 1 and g[0] != "<s>"}
    n, types = sum(single.values()), len(single)

    def p(history, word):
        if not history:
            return (single.get(word, 0) + 0.5) / (n + 0.5 * (types + 1))
        return (counts[(*history, word)] + strength * p(history[1:], word)) / (counts[history] + strength)

    out = []
    for s, train in zip(sequences, training, strict=True):
        base = sum(math.log10(p((), w)) for w in s[1:])
        own = sum(math.log10(p(tuple(s[max(0, a - order + 1) : a]), s[a])) for a in range(1, len(s)))
        out.append((train, len(s) - 1, sum(w in single for w in s[1:]), n, base, own))
    return out, p, [*single, "never seen"]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_equal_brute_force(spark, order):
    rng = np.random.default_rng(order)
    texts = [" ".join(rng.choice(list("abcdefXé"), rng.integers(0, 30))) for _ in range(60)]
    texts += [None, "", " \t\n", "A a a a\x1fb", texts[3], texts[3]]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.repartition(3).withColumn("training", F.lit("x")).withColumn("a.b", F.lit(1))
    got = lm.score(docs, trained(), order=order, strength=3.0, block_tokens=90, shard_keys=50).collect()
    want, _, _ = brute_scores(rows, order, 3.0)
    key = lambda r: (str(r[0]), r[2], r[-1])
    expected = sorted(((i, *w) for (i, _), w in zip(rows, want, strict=True)), key=key)
    for a, b in zip(sorted((tuple(r) for r in got), key=key), expected, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-12)


def test_coding_keeps_one_dictionary(monkeypatch):
    """A block's words go when it is done, without waiting for a garbage collection."""
    docs = mock.MagicMock()
    monkeypatch.setattr(lm, "F", mock.MagicMock())
    monkeypatch.setattr(lm, "TaskContext", mock.MagicMock(**{"get.return_value.partitionId.return_value": 2}))
    lm.coded(docs, 5)
    run = docs.select.return_value.mapInArrow.call_args[0][0]
    texts = [f"a{i} b{i} c{i} d".encode() for i in range(40)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(40)), "training": [True] * 40, "text": texts})
    gc.collect()
    gc.disable()
    try:
        blocks = [b.column("block")[0].as_py() for b in run(iter([batch]))]
        held = [x for x in gc.get_objects() if isinstance(x, defaultdict) and b"a7" in x]
    finally:
        gc.enable()
    assert blocks == [(2 << 32) + i for i in range(40)] and held == []


def test_probabilities_add_up(spark):
    """Over all words and one unknown, what follows any history has probability one."""
    rows = [(i, t) for i, t in enumerate(["a b a b c", "b b a", "c a", "", "a c c b"] * 3)]
    _, p, words = brute_scores(rows, 3, 2.0)
    docs = spark.createDataFrame([*rows, *((100 + 5 * k, f"a b {w}") for k, w in enumerate(["a", "b", "c", "zz"]))], "doc_id long, text string")
    assert sum(p(("a", "b"), w) for w in words) == pytest.approx(1)
    held = F.col("doc_id") < 100
    got = {r["doc_id"]: r for r in lm.score(docs, held & trained(), order=3, strength=2.0).collect()}
    for k, w in enumerate(["a", "b", "c", "zz"]):
        steps = [((), "a"), (("a",), "b"), (("a", "b"), w), (("b", w), "</s>")]
        steps[0], steps[1] = (("<s>",), "a"), (("<s>", "a"), "b")
        assert got[100 + 5 * k]["score"] == pytest.approx(sum(math.log10(p(h, x)) for h, x in steps))


def test_score_edge_cases(spark):
    docs = spark.createDataFrame([(1, "x y " * 40_000), (2, None)], "doc_id long, text string")
    none = lm.score(docs, F.lit(None).cast("boolean")).collect()
    assert {(r["n_tokens"], r["n_known"], r["train_tokens"], r["score"]) for r in none} == {(80_001, 0, 0, 0.0), (1, 0, 0, 0.0)}
    assert lm.score(docs.limit(0), trained()).count() == 0
    text_ids = docs.withColumn("doc_id", F.col("doc_id").cast("string"))
    assert {r["doc_id"] for r in lm.score(text_ids, F.lit(True)).collect()} == {"1", "2"}


def test_numbers_as_bytes():
    rng = np.random.default_rng(0)
    keys = np.sort(rng.integers(0, 2**64, 1000, np.uint64))
    assert (lm.unpacked_keys(lm.packed_keys(keys)) == keys).all()
    assert (lm.numbers(lm.planes(keys.astype(np.uint32)), np.uint32) == keys.astype(np.uint32)).all()
    assert lm.numbers(lm.planes(keys[:0]), np.uint64).size == 0
    starts = lm._shard_starts(keys, 7)
    assert starts[0] == 0 and starts[-1] == 1000 and (np.diff(starts) > 80).all()


# ---------------------------------------------------------------- whitening


def brute_whitening(vectors, k=4):
    dim = max(len(v) for v in vectors)
    x = np.array([np.pad(np.floor(256 * np.array(v, float)), (0, dim - len(v))) for v in vectors]).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    c = fit - s / n
    values, axes = np.linalg.eigh(c.T @ c / n)
    values, axes = values[::-1], axes[:, ::-1]
    return n, ((n * x - s) ** 2).sum(1), (x - s / n) @ axes[:, :k] / np.sqrt(values[:k]), values / values.sum()


def test_whitening_equals_numpy(spark, monkeypatch):
    for name, value in (("ROWS", 16), ("COLUMNS", 5), ("BLOCKS_A_TASK", 3)):
        monkeypatch.setattr(whiten, name, value)
    rng = np.random.default_rng(5)
    vectors = (rng.normal(size=(150, 12)) * np.linspace(3, 0.2, 12)).astype(np.float32).tolist()
    vectors += [vectors[0]] * 40 + [vectors[1][:7]]
    docs = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    got = {(r["vec_id"], r["component"]): r for r in whiten.whiten(docs).collect()}
    n, far, y, explained = brute_whitening(vectors)
    assert len(got) == 4 * len(vectors)
    for j in range(4):
        ours = np.array([got[i, j + 1]["whitened"] for i in range(len(vectors))])
        assert ours * np.sign(ours @ y[:, j]) == pytest.approx(y[:, j], abs=1e-9)
        assert got[0, j + 1]["explained"] == pytest.approx(explained[j], rel=1e-9)
    assert {r["n"] for r in got.values()} == {n} and n == 151
    assert [got[i, 1]["deviation"] for i in range(len(vectors))] == far.tolist()
    assert {r["identity_error"] < 1e-9 for r in got.values()} == {True}


def test_whitening_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, 0.0]), (2, [0.0, 0.25]), (2, [0.0, 0.25]), (None, [1.0]), (4, None), (5, [nan, 0.0]), (6, [inf, 0.0]), (7, [None, 0.0]), (8, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("position", F.lit(9)).withColumn("x", F.lit(0))
    got = whiten.whiten(table).collect()
    assert Counter(r["vec_id"] for r in got) == {1: 2, 2: 4, None: 2, 8: 2}
    assert {r["n"] for r in got} == {4}
    one = table.filter("vec_id = 1")
    assert whiten.whiten(one).count() == 0 and whiten.whiten(table.limit(0)).count() == 0
    assert whiten.whiten(table.filter("vec_id = 8")).count() == 0
    # One direction only: the others have no variance and are left out.
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(5)], "vec_id long, embedding array<double>")
    assert {r["component"] for r in whiten.whiten(line).collect()} == {1}
    huge = spark.createDataFrame([(0, [1e300]), (1, [-1e300]), (2, [0.0])], "vec_id long, embedding array<double>")
    assert {r["deviation"] for r in whiten.whiten(huge).collect()} == {0, 2**63 - 1}
