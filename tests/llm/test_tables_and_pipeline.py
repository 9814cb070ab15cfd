"""URL rules, vector search, the pipeline and the registered queries."""

import re
import time
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from biomeframe.llm import jaccard, lines, mix, pack, quality, topk, urls
from biomeframe.llm.queries import QUERIES
from biomeframe.session import materialise

SF = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- urls


def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest).group()
    path = re.match("[^?#]*", rest[len(host) :]).group()
    host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    fits = [
        (name + start, verdict)
        for verdict, name, start in urls.DOMAIN_RULES
        if (host == name or host.endswith("." + name)) and path.startswith(start)
    ]
    rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, None))
    return host, path, rule, verdict


URLS = [
    None, "", "no scheme", "http://", "http://a.com", "http://a.com/x", "https://Example.COM/en/1", "http://www.example.com/en/2",
    "http://m.www.example.com/en/2", "http://notexample.com/en/3", "http://x.net/es/1?u=http://y.com/", "http://x.net#/fr/",
    "http://net/fr/", "http://É.net/fr/é", "http://a.org/en/1", "http://b.net/en/7.html?a=1&b=2", "ftp://c.com?x",
]


def test_parsing_and_domain_rules(spark):
    docs = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    rows = urls.judge(docs.withColumn("host", F.lit("x")).withColumn("tokens", F.lit(1))).collect()
    for r in rows:
        host, path, rule, verdict = brute_url(URLS[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] in ("allow", "block") and (verdict is None or r["verdict"] == verdict)
        assert verdict is None or r["confidence"] is None
    assert urls.judge(docs.limit(0)).count() == 0
    assert {r["verdict"] for r in urls.judge(docs, rules=[]).collect()} == {"allow"}
    assert urls.judge(docs.union(docs)).count() == 2 * len(URLS)


def test_mined_rules_equal_counting(spark):
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(300):
        tokens = sorted({f"t{k}" for k in rng.integers(0, 7, 4)})
        bad = {"t1", "t2"} <= set(tokens) or "t6" in tokens
        rows.append((tokens, "block" if bad and rng.random() < 0.95 else "allow"))
    labelled = spark.createDataFrame(rows, "tokens array<string>, verdict string")
    got = {(tuple(r["tokens"]), r["verdict"]): r["confidence"] for r in urls.mined(labelled, 0.02, 0.8).collect()}
    seen, hit = Counter(), Counter()
    for tokens, verdict in rows:
        for k in range(1, len(tokens) + 1):
            for part in combinations(tokens, k):
                seen[part] += 1
                hit[part, verdict] += 1
    rules = {x: n / seen[x[0]] for x, n in hit.items() if n >= 0.02 * len(rows) and n / seen[x[0]] >= 0.8}
    want = {
        (part, v): c
        for (part, v), c in rules.items()
        if not any(rules.get((tuple(t for t in part if t != x), v), 0) >= c for x in part)
    }
    assert got == pytest.approx(want)


def brute_verdicts(rows, labels, min_support, min_confidence):
    """Best rule of every token set by trying all combinations: (confidence, support, verdict), or None."""
    labelled = [(t, v) for t, v in zip(rows, labels, strict=True) if v]
    seen, hit = Counter(), Counter()
    for tokens, verdict in labelled:
        for k in range(1, len(tokens) + 1):
            for part in combinations(tokens, k):
                seen[part] += 1
                hit[part, verdict] += 1
    n = len(labelled)
    rules = {x: (c / seen[x[0]], c / n) for x, c in hit.items() if c >= min_support * n and c / seen[x[0]] >= min_confidence}
    kept = {
        (part, v): r for (part, v), r in rules.items()
        if not any(rules.get((tuple(t for t in part if t != x), v), (0,))[0] >= r[0] for x in part)
    }
    out = []
    for tokens in rows:
        fits = [(c, s, v) for (part, v), (c, s) in kept.items() if set(part) <= set(tokens)]
        out.append(max(fits) if fits else None)
    return out


def test_judge_equals_a_search_over_all_rules(spark):
    rng = np.random.default_rng(12)
    parts = ["ads", "click", "news", "blog", "es", "fr", "en"]
    urls_ = []
    for i in range(400):
        host = rng.choice(["shop.net", "a.example.com", "b.org", "c.com", "d.info"])
        path = "/".join(rng.choice(parts, rng.integers(1, 4)))
        # utm and ref always come together.
        query = rng.choice(["", "?utm=1&ref=2", "?utm=3&ref=4&id=5", "?id=9"])
        urls_.append(f"http://{host}/{path}{query}")
    urls_ += [None, "no scheme", "http://", "https://d.info/ads?ref=1"]
    pages = spark.createDataFrame(list(enumerate(urls_)), "page_id long, url string")
    got = {r["page_id"]: r for r in urls.judge(pages, min_support=0.05, min_confidence=0.6).collect()}
    tokens = [tuple(r["t"]) for r in pages.select("page_id", urls.tokens_of(F.col("url")).alias("t")).orderBy("page_id").collect()]
    labels = [got[i]["verdict"] if got[i]["rule"] else None for i in range(len(urls_))]
    assert {"allow", "block", None} == set(labels)
    mined_ones = 0
    for i, best in enumerate(brute_verdicts(tokens, labels, 0.05, 0.6)):
        if labels[i] is None:
            assert got[i]["verdict"] == (best[2] if best else urls.DEFAULT), urls_[i]
            assert got[i]["confidence"] == (pytest.approx(best[0]) if best else None)
            mined_ones += best is not None
    assert mined_ones > 50


def test_parameters_that_come_together_are_one_item(spark):
    common = "&".join(f"p{k}=1" for k in range(40))
    rows = [(i, f"http://{'x.com/en' if i % 2 else 'y.net/es'}/a{i % 7}?{common}&{'good' if i % 2 else 'bad'}=1") for i in range(10_000)]
    rows += [(20_000, "http://z.org/q?p3=1&bad=2"), (20_001, f"http://z.org/q?{common}")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    start = time.monotonic()
    got = {r["page_id"]: r["verdict"] for r in urls.judge(pages).collect()}
    assert time.monotonic() - start < 30
    assert got[20_000] == "block" and got[20_001] == "allow" and got[0] == "block" and got[1] == "allow"


def test_matching_takes_the_best_rule(spark):
    rules = spark.createDataFrame(
        [(["a"], "allow", 0.9, 0.5), (["a", "b"], "block", 0.95, 0.1), (["c"], "block", 0.9, 0.4), (["z"], "allow", 1.0, 0.1)],
        "tokens array<string>, verdict string, confidence double, support double",
    )
    sets = spark.createDataFrame([(["a"],), (["a", "b"],), (["a", "c"],), (["d"],)], "tokens array<string>")
    got = {tuple(r["tokens"]): r["best"]["verdict"] for r in urls.matched(sets, rules).collect()}
    assert got == {("a",): "allow", ("a", "b"): "block", ("a", "c"): "allow"}


# ---------------------------------------------------------------- vectors


def brute_top(rows, is_query, k=5):
    usable = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            usable.append((i, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
    first = {}
    for i, v in usable:
        if is_query(i):
            packed = np.array(v, "<i8").tobytes()
            first[i] = min(first.get(i, (packed, v)), (packed, v))
    out = []
    for i, (_, q) in first.items():
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in usable if j != i)[:k]
        out += [(i, n, j, -s) for n, (s, j) in enumerate(scored, 1)]
    return sorted(out)


def search(spark, rows, every=3, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit("x"))
    got = topk.top_k(df, F.col("vec_id") % every == 0, **how).collect()
    return sorted(map(tuple, got))


@pytest.mark.parametrize("spread", [0.0, 1.5])
def test_top_k_matches_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 8)
    monkeypatch.setattr(topk, "HEAD", 20)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(150, 40)) * np.exp(spread * rng.normal(size=(150, 1))) * np.geomspace(1, 0.05, 40)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(200 + i, x[0].tolist()) for i in range(40)]  # one very common vector: ties
    assert search(spark, rows) == brute_top(rows, lambda i: i % 3 == 0)


def test_short_vectors_are_not_sent_to_every_lane(spark, monkeypatch, caplog):
    for name, value in (("BLOCK", 8), ("HEAD", 16), ("QUERIES_TOGETHER", 4)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(9)
    long = np.abs(rng.normal(size=(20, 6))) * 50
    short = rng.normal(size=(400, 6)) * 0.05
    # The queries point where the long vectors do, so none of the many short ones can be among their best.
    rows = [(1000 + i, v.tolist()) for i, v in enumerate(long)] + [(3 * i + 1, v.tolist()) for i, v in enumerate(short)]
    rows += [(3 * i, np.abs(v).tolist()) for i, v in enumerate(rng.normal(size=(30, 6)))]
    with caplog.at_level("INFO", topk.__name__):
        got = search(spark, rows)
    assert got == brute_top(rows, lambda i: i % 3 == 0)
    told = next(r for r in caplog.records if "pairs of query groups" in r.message)
    sent, every = told.args
    assert 0 < sent < 0.3 * every


def test_reaches_counts_the_lanes_that_can_hold_a_hit():
    rng = np.random.default_rng(4)
    norms = np.sort(rng.exponential(size=30))[::-1] * 100
    lengths = np.concatenate([rng.exponential(size=200) * 300, [0.0, 0.0]])
    floors = np.concatenate([rng.integers(-500, 40_000, 200), [1, 2]])
    floors[:5] = -(2**63)
    far = topk.reaches(lengths, floors, norms)
    for n, length, floor in zip(far, lengths, floors, strict=True):
        can = length * norms * (1 + 1e-9) + 1 >= floor
        assert can.sum() <= n <= can.sum() + 1


def test_top_k_edge_cases(spark):
    rows = [
        (0, [1.0, 2.0]), (0, [3.0, 1.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 0.0]), (4, [float("inf"), 0.0]),
        (5, []), (6, [1.0]), (None, [9.0, 9.0]), (7, [-1.0, 0.0039]), (9, [0.0, 0.0]),
    ]
    want = brute_top(rows, lambda i: i % 3 == 0)
    assert search(spark, rows) == want and len(want) < 5 * 4
    assert search(spark, []) == [] and search(spark, [(1, [1.0])]) == []
    huge = [(0, [1e18, 1e18]), (1, [1e18, 1.0]), (2, [1.0, 0.0])]
    assert [r[:3] for r in search(spark, huge)] == [(0, 1, 1), (0, 2, 2)]
    long = [(i, np.linspace(i, 1, 200).tolist()) for i in range(6)]
    assert search(spark, long) == brute_top(long, lambda i: i % 3 == 0)


def test_queries_are_not_copied_per_lane_in_a_broadcast(spark, monkeypatch):
    """The driver gets neither the pairs of queries and lanes nor the head's vectors from every task."""
    for name, value in (("BLOCK", 8), ("QUERY_BLOCK", 8), ("HEAD", 16), ("QUERIES_TOGETHER", 4), ("GROUPS_A_TASK", 2)):
        monkeypatch.setattr(topk, name, value, raising=False)
    plans = []

    def kept(df, **options):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return materialise(df, **options)

    monkeypatch.setattr(topk, "materialise", kept)
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(120, 6)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = topk.top_k(df, F.col("vec_id") % 3 == 0)
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    assert sorted(map(tuple, got.collect())) == brute_top(rows, lambda i: i % 3 == 0)
    assert not any("Broadcast" in p for p in plans) and any("CartesianProduct" in p for p in plans)


def test_longest_rows_come_from_the_first_blocks(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(90)] + [(500 + i, [1.0, 2.0, 2.0]) for i in range(9)]
    df = topk.materialise(topk.integers(spark.createDataFrame(rows, "i long, v array<double>"), "i", "v"))
    ordered = df.repartitionByRange(4, F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id")
    stored = topk.materialise(topk.blocks(ordered, 3, 7).withColumn("at", F.monotonically_increasing_id()))
    for size in (1, 7, 20, 98, 99, 400):
        ids, vectors = topk.longest(stored, size, 3)
        want = df.orderBy(F.desc("norm"), "vec_id").limit(size).collect()
        assert ids.tolist() == [r["vec_id"] for r in want]
        assert vectors.tolist() == [np.frombuffer(r["v"], "<i8").tolist() for r in want]


def test_one_product_scores_as_single_rows_do():
    rng = np.random.default_rng(7)
    q, c = rng.integers(-300, 300, (6, 8)), rng.integers(-300, 300, (40, 8))
    few = [(1, np.array([3])), (4, np.array([0, 39]))]
    for found in ([(i, np.arange(40)) for i in range(6)], few, []):
        got = list(topk.scored_candidates(q, c, found))
        assert [(row, s.tolist()) for row, _, s in got] == [(row, (c[at] @ q[row]).tolist()) for row, at in found]
    # Beyond doubles the products stay exact.
    q[0, 0] = c[0, 0] = 2**40
    (_, _, s), = topk.scored_candidates(q, c, [(0, np.arange(40))])
    assert s[0] == 2**63 - 1 and s[1] == sum(int(a) * int(b) for a, b in zip(q[0], c[1], strict=True))


def test_bounds_never_exclude_a_hit():
    rng = np.random.default_rng(3)
    q, c = rng.integers(-300, 300, (20, 64)), rng.integers(-300, 300, (50, 64))
    axes = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    exact = q @ c.T
    floors = np.sort(exact, 1)[:, -3]
    norm = float(np.sqrt(np.square(c).sum(1)).max())
    left = dict(topk.candidates(q, floors, c, norm, axes))
    for i in range(20):
        assert set(np.flatnonzero(exact[i] >= floors[i])) <= set(left[i])


# ---------------------------------------------------------------- pipeline


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's input and output, written and read again."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out, folder = [], tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return out


def test_stages_keep_the_columns(stages):
    assert [n for n, *_ in stages] == ["quality", "lines", "near_copies", "mix", "pack"]
    for _, before, after in stages[:-1]:
        assert after.dtypes == before.dtypes
        assert after.filter("n_chars <> length(text)").count() == 0


def test_stages_do_their_work(spark, stages):
    (_, raw, good), (_, _, cut), (_, _, single), (_, _, mixed), (_, _, packed) = stages
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    clean = raw.join(labels.filter("quality = 1"), "doc_id", "left_semi")
    assert clean.join(good, "doc_id", "left_semi").count() >= 0.97 * clean.count()
    junk = raw.join(labels.filter("quality = 0"), "doc_id", "left_semi")
    assert good.join(junk.select("doc_id"), "doc_id", "left_semi").count() <= 0.2 * junk.count()
    assert cut.count() == good.count()
    again = lines.drop_frequent_lines(good).select("doc_id", "text")
    assert again.exceptAll(cut.select("doc_id", "text")).isEmpty()
    groups = jaccard.components(cut).collect()
    assert sorted(r["doc_id"] for r in single.collect()) == sorted({r["component_id"] for r in groups})
    assert mixed.select("doc_id", "text").distinct().exceptAll(raw.select("doc_id", "text").unionByName(single.select("doc_id", "text"))).isEmpty()
    words = mix.mix(single).agg(F.sum("taken")).first()[0]
    assert mixed.select(F.sum(mix.word_count(F.col("text")))).first()[0] == words
    totals = pack.pack(mixed).groupBy("doc_id").agg(F.sum("length").alias("n"))
    assert packed.groupBy("doc_id").agg(F.sum("length").alias("n")).exceptAll(totals).isEmpty()


def test_pipeline_runs_as_one(spark, stages):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == stages[-1][2].columns
    assert rows.agg(F.sum("length")).first() == stages[-1][2].agg(F.sum("length")).first()


def test_pipeline_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


# ---------------------------------------------------------------- queries


def test_every_operator_is_registered():
    numbers = sorted(int(re.match(r"op(\d+)_", n).group(1)) for n in QUERIES)
    assert numbers == list(range(1, 14)) and "pipeline" in queries()
    assert QUERIES.keys() <= queries().keys()
    sql_forms = {n for n in oracle_sql() if n.startswith("op")}
    assert sql_forms == {n for n in QUERIES if re.match(r"op([15789]|11)_", n)}


COLUMNS = {
    "op1": "doc_id size source_size target taken", "op2": "doc_id held_out lang_pred score",
    "op3": "doc_id start length ids_crc32 doc_tokens sequence_id offset", "op4": "doc_id held_out score predicted",
    "op5": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op6": "page_id host path rule verdict", "op7": "doc_id n_lines n_dropped kept_sha256",
    "op8": "doc_id n_shingles component_id", "op9": "query_id rank vec_id score",
    "op10": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op11": "word form root n n_near form_n",
    "op12": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op13": "vec_id component n deviation whitened explained identity_error",
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_columns_and_rows(spark, name):
    df = QUERIES[name](spark, SF)
    assert set(COLUMNS[name.split("_")[0]].split()) <= set(df.columns)
    rows = df.collect()
    number = name.split("_")[0]
    if number == "op11":
        assert len({r["word"] for r in rows}) == len(rows) > 0
        return
    table = {"op6": "pages", "op9": "embeddings", "op13": "embeddings"}.get(number, "documents")
    key = {"op6": "page_id", "op9": "query_id", "op13": "vec_id"}.get(number, "doc_id")
    source = pq.read_table(f"{SF}/{table}.parquet").column(0).to_pylist()
    want = {i for i in source if i % 50 == 0} if number == "op9" else set(source)
    assert {r[key] for r in rows} == want


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    lang = QUERIES["op2_ecoc_language"](spark, sf).filter("held_out").join(docs, "doc_id")
    right, n = lang.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count(F.lit(1))).first()
    assert right >= 0.97 * n > 0
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    judged = QUERIES["op4_quadratic_quality"](spark, sf).filter("held_out").join(labels, "doc_id")
    right, n = judged.agg(F.count_if(F.col("quality") == F.col("predicted")), F.count(F.lit(1))).first()
    assert right >= 0.95 * n > 0


def test_defaults_are_those_of_the_contract():
    assert (mix.WEIGHTS, mix.SHARE, mix.CAP) == ((5, 2, 1), 1.5, 2.0)
    assert (pack.WINDOW, quality.THRESHOLD, topk.TOP) == (2048, 0.3, 5)
    assert (jaccard.WORDS, jaccard.PERCENT, lines.MIN_DOCUMENTS, lines.MIN_LENGTH) == (5, 80, 10, 1)
