"""Operators on documents against brute force, and the cases each docstring defines."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from biomeframe.llm import jaccard, language, lines, mix, pack, pii, quality, rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 30_000


def documents(spark, texts, **columns):
    n = len(texts)
    langs, sources = columns.get("lang", ["en"] * n), columns.get("source", ["s"] * n)
    rows = [(i, t, langs[i], sources[i], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


EDGES = [None, "", " \n\t ", "one", "one", LONG, "a b c d e f", "A b C d e f", "x\x00y ü ß", "\n\n"]


@pytest.fixture(scope="module")
def edges(spark):
    return documents(spark, EDGES, source=["s", None, "t", "s", "s", "t", None, "s", "t", "s"])


# ---------------------------------------------------------------- mixing


def test_targets_fill_by_weight_up_to_the_cap(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100), ("c", 1000), (None, 40)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mix.targets(sizes).collect()}
    caps = {"a": 20.0, "b": 200.0, "c": 2000.0, None: 80.0}
    weights = {"a": 5, "b": 2, "c": 1, None: 5}
    total = 1.5 * 1150
    full = set()
    while True:  # the excess is shared again until no source is above its cap
        level = (total - sum(caps[s] for s in full)) / sum(w for s, w in weights.items() if s not in full)
        more = {s for s in weights if s not in full and level * weights[s] > caps[s]}
        if not more:
            break
        full |= more
    want = {s: caps[s] if s in full else level * weights[s] for s in weights}
    assert got == pytest.approx(want)
    assert sum(got.values()) == pytest.approx(total)


def test_mix_reaches_targets_and_repeats(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(["w"] * int(k)) for k in rng.integers(0, 90, 400)]
    docs = documents(spark, texts, source=[f"s{min(3, i % 7)}" for i in range(400)])
    rows = mix.mix(docs).collect()
    assert sorted(rows) == sorted(mix.mix(docs.repartition(7)).collect())
    by = defaultdict(list)
    for r in rows:
        assert r["size"] == len(texts[r["doc_id"]].split()) and 0 <= r["taken"] <= 2 * r["size"]
        by[r["source"]].append(r)
    for source in by.values():
        # Whole documents: off by half of the one at the cut at most.
        assert abs(sum(r["taken"] for r in source) - source[0]["target"]) <= 1 + max(r["size"] for r in source) / 2
        assert all(r["taken"] % r["size"] == 0 for r in source if r["size"])
    text = mix.mixed(docs).select("doc_id", "text").collect()
    words = Counter()
    for r in text:
        assert texts[r["doc_id"]] == r["text"]
        words[r["doc_id"]] += len(r["text"].split())
    assert words == Counter({r["doc_id"]: r["taken"] for r in rows if r["taken"]})


def test_inclusion_follows_the_target_share(spark):
    """Over many seeds a document is taken as often as its source's target says."""
    docs = documents(spark, ["w w w"] * 60, source=["a"] * 20 + ["b"] * 40)
    taken = np.zeros(60)
    for seed in range(12):
        for r in mix.mix(docs, seed=seed).collect():
            taken[r["doc_id"]] += r["taken"] / 3
    assert taken[:20].mean() / 12 == pytest.approx(2.0, abs=0.05)
    assert taken[20:].mean() / 12 == pytest.approx(1.25, abs=0.05)
    assert len(set(taken[20:])) > 1


def test_mix_edge_cases(spark, edges):
    rows = {r["doc_id"]: r for r in mix.mix(edges).collect()}
    assert rows[0]["size"] == rows[1]["size"] == rows[2]["taken"] == 0 and rows[5]["size"] == 30_000
    assert rows[1]["source_size"] == 6 and len(rows) == len(EDGES)
    assert mix.mix(edges.limit(0)).count() == 0 and mix.mixed(edges.limit(0)).count() == 0
    clash = edges.withColumn("size", mix.F.lit("x")).withColumn("taken", mix.F.lit(None)).withColumn("_p", mix.F.lit(1))
    assert sorted(mix.mix(clash).collect(), key=str) == sorted(mix.mix(edges).collect(), key=str)
    assert mix.mixed(clash).columns == clash.columns
    dotted = edges.withColumn("a.b", mix.F.lit(1)).withColumn("_doc", mix.F.lit(2))
    assert mix.mixed(dotted).columns == dotted.columns and mix.mixed(dotted).count() == mix.mixed(edges).count()
    twice = mix.mix(edges.union(edges)).groupBy("doc_id").count().collect()
    assert {r["count"] for r in twice} == {2}


# ---------------------------------------------------------------- packing


def test_best_fill_is_optimal():
    rng = np.random.default_rng(3)
    for _ in range(200):
        counts = dict(Counter(rng.integers(1, 40, rng.integers(1, 9)).tolist()))
        room = int(rng.integers(1, 90))
        sums = {0}
        for length, n in counts.items():
            sums = {s + k * length for s in sums for k in range(n + 1)}
        chosen = pack.best_fill(counts, sorted(counts), room)
        assert not Counter(chosen) - Counter(counts)
        assert sum(chosen) == max(s for s in sums if s <= room)


def check_packed(texts, rows, window):
    words = pack.WordIds(None)
    ids = {i: words.encoded(t or "") + b"\x01\0\0\0" for i, t in texts.items()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
        part = ids[r["doc_id"]][4 * r["start"] : 4 * (r["start"] + r["length"])]
        assert r["ids_crc32"] == zlib.crc32(part) and r["length"] > 0
        assert r["doc_tokens"] == len(ids[r["doc_id"]]) // 4
    for i, data in ids.items():
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["length"]
        assert at == len(data) // 4
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window and at & (at - 1) == 0


def test_packing_round_trip(spark, edges):
    texts = dict(enumerate(EDGES))
    texts |= {100: "Ça n'est pas <|endoftext|> l'été; ΣΑΣ İstanbul ﬁ 1234 don't", 101: "é x\x1cy z", 102: "日本語 テキスト"}
    docs = documents(spark, EDGES).select("doc_id", "text")
    more = spark.createDataFrame([(i, t) for i, t in texts.items() if i >= 100], "doc_id long, text string")
    check_packed(texts, pack.digests(pack.pack(docs.union(more).coalesce(1))).collect(), 2048)
    check_packed(texts, pack.digests(pack.pack(docs.union(more).repartition(3), window=64, pool_tokens=200)).collect(), 64)
    assert pack.pack(docs.limit(0)).count() == 0
    assert pack.pack(docs.limit(4)).filter("doc_id = 0").count() == 1


@pytest.mark.parametrize("packed", [pack.stored, lambda docs: corpus_pipeline.pack_sequences(docs.sparkSession, docs, "")])
def test_packing_sends_few_texts_at_a_time(spark, monkeypatch, tmp_path, packed):
    """A Python worker gets the rows in small batches, also when the caller's session has large ones."""
    rows = 2 * pack.BATCH_ROWS + 500
    docs = spark.range(rows).selectExpr("id doc_id", "concat('word ', id) text").coalesce(1)
    log, whole = tmp_path / "batches", pack.slices

    def seen(texts, size):
        with log.open("a") as file:
            print(len(texts), file=file)
        yield from whole(texts, size)

    monkeypatch.setattr(pack, "slices", seen)
    pieces = packed(docs).collect()
    batches = [int(n) for n in log.read_text().split()]
    assert max(batches) <= pack.BATCH_ROWS and sum(batches) == rows
    monkeypatch.undo()
    assert sorted(pieces) == sorted(pack.digests(pack.pack(docs)).collect())
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"


def test_word_ids_equal_the_whole_tokenizer():
    rng = np.random.default_rng(12)
    pool = [chr(i) for i in range(1, 0x250)] + list(" \n\t'.-1a" * 20) + list("\u0301日ﬁΣ\u2003\x00𝄞")
    words = pack.WordIds(None)
    for _ in range(2000):
        text = "".join(rng.choice(pool, rng.integers(0, 14)))
        assert words.of(text) == words.encoded(text), ascii(text)


def word_texts():
    """Texts of many words in many spellings, with every kind of white space at both ends and null, special and wide ones."""
    rng = np.random.default_rng(31)
    stems = ["".join(rng.choice(list("abcdeéßñ'.!1"), rng.integers(1, 7))) for _ in range(300)]
    stems += ["don't", "İstanbul", "ΣΑΣ", "日本語", "“quoted”", "Ⱥb", "x\x1cy", "e\u0301", "</w>", "#</w>a"]
    gaps = [" ", "  ", "\n", "\t\x0b", "\x85", "\xa0", "\u2003", "\u2028 ", "\u3000"]
    texts = [None, "", " ", "\n.", ". ", "a<|endoftext|>b", "<|", "\u3000", "!\u3000"]
    for _ in range(400):
        words = [str(w).upper() if rng.random() < 0.3 else str(w) for w in rng.choice(stems, rng.integers(0, 40))]
        texts.append("".join(w + str(rng.choice(gaps)) for w in words) + str(rng.choice(["", "z", "! "])))
    return texts


def test_word_ids_of_many_texts_make_each_part_once(monkeypatch):
    texts, words = word_texts(), pack.WordIds(None)
    made = []
    make = words.part_ids.make
    words.part_ids.make = lambda parts: made.extend(parts.to_pylist()) or make(parts)
    expected = [words.encoded(t or "") for t in texts]
    for kind in (pack.pa.string(), pack.pa.large_string()):
        column = pack.pa.array(texts, kind)
        found = [i for a, b in pack.slices(column, 2_000) for i in words.of_texts(column[a:b])]
        assert found == expected
    assert len(made) == len(set(made)) and "" not in made and len(made) > 200
    known = len(words.part_ids.keys)
    # A store that is full is emptied, and short calls change nothing.
    monkeypatch.setattr(pack, "KNOWN_BYTES", 500)
    monkeypatch.setattr(pack, "CALL", 3)
    assert [i for a, b in pack.slices(column, 2_000) for i in words.of_texts(column[a:b])] == expected
    more = pack.pa.array(["Unseen%s words" % chr(97 + i % 26) * 3 for i in range(40)])
    assert list(words.of_texts(more)) == [words.encoded(t) for t in more.to_pylist()]
    assert len(words.part_ids.keys) == 1 < known
    assert [b - a for a, b in pack.slices(column, 1)] == [1] * len(texts) and not list(pack.slices(column[:0], 1))


def test_blanks_at_the_end_of_the_last_text():
    """What lies in memory behind the texts of a batch plays no part."""
    words = pack.WordIds(None)
    data = "on . \n".encode() + b"\xff\xfe\xff"
    offsets = pack.np.array([0, 3, len(data) - 3], "<i4")
    texts = pack.pa.StringArray.from_buffers(2, pack.pa.py_buffer(offsets), pack.pa.py_buffer(data))
    assert list(words.of_texts(texts)) == [words.encoded("on "), words.encoded(". \n")]
    behind = pack.pa.LargeStringArray.from_buffers(1, pack.pa.py_buffer(pack.np.array([0, 2], "<i8")), pack.pa.py_buffer(b". \xff\xff"))
    assert pack.lists_of(behind, lambda w: w.cast(pack.pa.large_binary()))[1].to_pylist() == [b".", b""]


def test_word_ids_of_a_vocabulary_without_suffix(tmp_path):
    import json

    import public_tokenizers

    with open(public_tokenizers.path(pack.VOCABULARY), encoding="utf-8") as file:
        vocabulary = json.load(file)
    vocabulary["model"]["end_of_word_suffix"] = None
    path = tmp_path / "plain.json"
    path.write_text(json.dumps(vocabulary), encoding="utf-8")
    words, texts = pack.WordIds(str(path)), word_texts()[:60]
    assert list(words.of_texts(pack.pa.array(texts))) == [words.encoded(t or "") for t in texts]


def test_equal_lengths_are_cut_to_fit():
    """A pool of one length cannot fill windows by whole pieces alone."""
    docs = [(i, bytes(4 * 1500)) for i in range(400)]
    fills = [sum(len(p[2]) for p in s) // 4 for s in pack.sequences(iter(docs), 2048, 50_000)]
    assert sum(fills) == 600_000 and all(f & (f - 1) == 0 for f in fills) and sum(f != 2048 for f in fills) <= 11


# ---------------------------------------------------------------- language and quality


def words_of(rng, letters, n):
    return " ".join("".join(rng.choice(list(letters), rng.integers(2, 7))) for _ in range(n))


def test_language_is_learned_and_whole_texts_count(spark):
    rng = np.random.default_rng(2)
    alphabets = {"xx": "abcdefgh", "yy": "ijklmnop", "zz": "qrstuvwx", "ww": "aeiouyéè"}
    texts, langs = [], []
    for i in range(240):
        lang = list(alphabets)[i % 4]
        texts.append(words_of(rng, alphabets[lang], 30))
        langs.append(lang if i < 160 else None)
    docs = documents(spark, texts + [None, "", "123 !?", LONG], lang=langs + [None] * 4)
    model = language.fit(docs)
    got = {r["doc_id"]: r for r in language.predict(docs, model).collect()}
    assert model.codes.shape == (4, 7)
    for i in range(240):
        assert got[i]["lang_pred"] == list(alphabets)[i % 4] and 0.5 < got[i]["score"] <= 1
    assert [got[i]["lang_pred"] for i in (240, 241, 242)] == ["und"] * 3 and got[242]["score"] == 0
    assert got[243]["lang_pred"] in alphabets


def test_codewords_are_apart():
    for n in (2, 3, 5, 9, 40):
        codes = language.codewords(n)
        distance = (codes[:, None] != codes[None]).sum(2)
        assert distance[~np.eye(n, dtype=bool)].min() >= (1 if n == 2 else 2)
        assert (np.abs(codes.sum(0)) < n).all()


def test_language_without_classes(spark, edges):
    none = language.fit(edges.withColumn("lang", mix.F.lit(None).cast("string")))
    assert {(r["lang_pred"], r["score"]) for r in language.predict(edges, none).collect()} == {("und", 0.0)}
    one = language.fit(edges)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(edges, one).collect()}
    assert got[3] == ("en", 1.0) and got[0] == ("und", 0.0)
    assert language.predict(edges.limit(0), one).count() == 0


def test_quality_matches_a_direct_discriminant(spark):
    rng = np.random.default_rng(4)
    good = [words_of(rng, "abcdefghij", rng.integers(20, 200)) + "." for _ in range(150)]
    bad = [" ".join(w + "#$%" for w in words_of(rng, "abcdefghij", rng.integers(20, 200)).split()) for _ in range(90)]
    docs = documents(spark, good + bad + [None, ""])
    labels = [(i, int(i < 150), 0) for i in range(240) if i % 3] + [(1, None, 0), (1, 1, 0), (None, 1, 0), (9_999, 0, 0)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    measured = quality.stored(docs)
    model = quality.fit(measured, labels, shrink=0.2, ridge=0.1, temper=1.0)
    x = np.array([quality.statistics(t) for t in good + bad])
    y, used = np.arange(240) < 150, np.arange(240) % 3 > 0
    means = [x[used & (y == k)].mean(0) for k in (0, 1)]
    covs = [np.cov(x[used & (y == k)].T, bias=True) for k in (0, 1)]
    n = [(used & (y == k)).sum() for k in (0, 1)]
    pooled = (n[0] * covs[0] + n[1] * covs[1]) / sum(n)
    target = 0.9 * pooled + 0.1 * np.eye(len(pooled)) * np.trace(pooled) / len(pooled)
    log = []
    for k in (0, 1):
        c = 0.8 * covs[k] + 0.2 * target
        d = x - means[k]
        log.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) - 0.5 * np.linalg.slogdet(c)[1] + np.log(n[k]))
    want = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
    got = {r["doc_id"]: r for r in quality.score(measured, model).collect()}
    np.testing.assert_allclose([got[i]["score"] for i in range(240)], want, atol=1e-6)
    assert all(got[i]["predicted"] == int(i < 150) for i in range(240))
    assert 0 <= got[240]["score"] == got[241]["score"] <= 1
    assert sorted(r["doc_id"] for r in quality.keep(docs, model).collect() if r["doc_id"] < 240) == list(range(150))


def test_quality_with_one_label_or_none(spark, edges):
    measured = quality.stored(edges)
    ones = spark.createDataFrame([(3, 1)], "doc_id long, quality int")
    assert {r["score"] for r in quality.score(measured, quality.fit(measured, ones)).collect()} == {1.0}
    assert {r["score"] for r in quality.score(measured, quality.fit(measured, ones.limit(0))).collect()} == {0.5}
    assert quality.score(quality.stored(edges.limit(0)), quality.fit(measured, ones)).count() == 0


# ---------------------------------------------------------------- rules


def brute_figures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(8)}
    lined = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lined) - len(set(lined)), len(covered))


def test_rules_figures_are_exact(spark, edges):
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(list("abc|"), 40)) + "\n" * (i % 3) + "x y\nx y" for i in range(60)]
    texts += [" ".join(map(str, range(9))) + " - " + " ".join(map(str, range(9))), "é𝄞 " * 9]
    docs = documents(spark, EDGES + texts)
    for r in rules.judge(docs).collect():
        got = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert got == brute_figures(r["text"])
        assert r["base_failed"] == (got[0] < 20 or 100 * got[4] > 30 * got[0])
        assert not (r["kept"] and (r["base_failed"] or r["failed"]))
    assert rules.judge(docs.limit(0)).count() == 0
    clash = docs.withColumn("n_words", mix.F.lit("x")).withColumn("kept", mix.F.lit(0))
    assert rules.judge(clash).select("kept").collect() == rules.judge(docs).select("kept").collect()


def test_thresholds_are_data(spark):
    docs = documents(spark, ["the cat sat on the mat and it was a good cat for all of us to see in the sun"] * 2)
    assert [r["failed"] for r in rules.judge(docs, thresholds=[("t", "stop_word_ratio", "<=", 0.1)]).collect()] == [["t"]] * 2
    assert all(r["kept"] for r in rules.judge(docs).collect())


# ---------------------------------------------------------------- lines


def test_lines_match_brute_force(spark):
    rng = np.random.default_rng(7)
    pool = ["Menu ", "\tmenu", "menu", "Über uns", "über uns", "", "  ", "footer\r", "unique a", "unique b"]
    texts = ["\n".join(rng.choice(pool, rng.integers(1, 8))) for _ in range(80)] + EDGES
    docs = documents(spark, texts)
    key = lambda x: re.sub("[A-Z]+", lambda m: m.group().lower(), x.strip(" \t\n\x0b\x0c\r"))
    held = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")})
    for r in lines.drop_frequent_lines(docs).collect():
        split = (texts[r["doc_id"]] or "").split("\n")
        stay = [x for x in split if not key(x) or held[key(x)] < 10]
        assert r["text"] == "\n".join(stay)
        assert (r["n_lines"], r["n_dropped"]) == (len(split), len(split) - len(stay))


def test_lines_edge_cases(spark, edges):
    got = {r["doc_id"]: r for r in lines.drop_frequent_lines(edges, min_documents=2).collect()}
    assert got[0]["text"] == "" and got[0]["n_lines"] == 1 and got[0]["n_dropped"] == 0
    assert got[3]["text"] == got[4]["text"] == "" and got[3]["n_dropped"] == 1
    assert got[6]["text"] == "" and got[9]["text"] == "\n\n" and got[9]["n_lines"] == 3
    assert lines.drop_frequent_lines(edges.limit(0)).count() == 0
    clash = edges.withColumn("n_lines", mix.F.lit("x")).withColumn("key", mix.F.lit(1)).withColumn("fp", mix.F.lit(2))
    assert lines.drop_frequent_lines(clash).count() == len(EDGES)


# ---------------------------------------------------------------- near copies


def brute_components(texts, ids=None):
    sets = []
    for t in texts:
        lowered = re.sub("[A-Z]+", lambda m: m.group().lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            both = len(a & b)
            if a and b and 100 * both >= 80 * (len(a) + len(b) - both):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [(i, len(a), root(i)) for i, a in enumerate(sets)]


def edited(rng, words, edits):
    out = list(words)
    for at in rng.integers(0, len(out), edits):
        out[at] = f"e{rng.integers(10**6)}"
    return " ".join(out)


def near_copies(rng, n):
    vocabulary = [f"w{i}" for i in range(300)]
    shared = list(rng.choice(vocabulary, 60))
    texts = []
    for _ in range(n):
        kind = rng.integers(4)
        if kind == 0:  # chains of near copies, some of them just below the threshold
            base = list(rng.choice(vocabulary, rng.integers(5, 90)))
            texts += [edited(rng, base, k) for k in range(4)] + [" ".join(base).upper()]
        elif kind == 1:  # a passage that many documents share
            texts.append(" ".join(shared + list(rng.choice(vocabulary, rng.integers(0, 40)))))
        elif kind == 2:
            texts.append(edited(rng, shared * 2, rng.integers(0, 9)))
        else:
            texts.append(" ".join(rng.choice(vocabulary, rng.integers(1, 6))))
    return texts


@pytest.mark.parametrize("few, sample", [(64, 16), (3, 1), (64, 1)])
def test_components_match_brute_force(spark, monkeypatch, few, sample):
    monkeypatch.setattr(jaccard, "FEW", few)
    monkeypatch.setattr(jaccard, "SAMPLE", sample)
    texts = near_copies(np.random.default_rng(few + sample), 60) + EDGES
    got = jaccard.components(documents(spark, texts)).collect()
    assert sorted(map(tuple, got)) == brute_components(texts)


def test_a_large_group_of_near_copies_stays_linear(spark):
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(200)]
    texts = [edited(rng, base, 2) for _ in range(600)] + [" ".join(base)] * 300
    rows = jaccard.components(documents(spark, texts).repartition(8)).collect()
    assert {r["component_id"] for r in rows} == {0} and len(rows) == 900
    kept = jaccard.one_of_each(documents(spark, texts)).collect()
    assert [r["doc_id"] for r in kept] == [0] and kept[0]["text"] == texts[0]


def test_component_edge_cases(spark, edges):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.components(edges).collect()}
    assert got[0] == (0, 0) and got[1] == (0, 1) and got[2] == (0, 2)
    assert got[3] == got[4] == (1, 3) or (got[3], got[4]) == ((1, 3), (1, 3))
    assert got[6] == (2, 6) and got[7] == (2, 6) and got[5] == (1, 5)
    assert jaccard.components(edges.limit(0)).count() == 0
    null = edges.withColumn("doc_id", mix.F.when(mix.F.col("doc_id") != 3, mix.F.col("doc_id")))
    rows = [(r["doc_id"], r["component_id"]) for r in jaccard.components(null.withColumn("unit", mix.F.lit("x"))).collect()]
    assert (None, None) in rows and (4, 4) in rows
    # Rows without an id are judged too: of the two rows "one" and of the pair that differs by case one stays.
    kept = [(r["doc_id"], r["text"]) for r in jaccard.one_of_each(null).collect()]
    assert sorted(kept, key=str) == sorted([(4, "one"), *((i, EDGES[i]) for i in (0, 1, 2, 5, 6, 8, 9))], key=str)


def test_one_of_each_judges_rows(spark):
    rng = np.random.default_rng(12)
    text = [words_of(rng, "abcdefgh", 60) for _ in range(5)]
    near = [f"{t} x" for t in text]
    rows = [(1, text[0], "p"), (2, near[0], "p"), (2, text[1], "p"), (3, text[2], "p"), (3, text[2], "q"), (3, near[2], "p")]
    rows += [(None, text[3], "p"), (None, near[3], "p"), (None, text[3], "p"), (None, near[1], "p"), (5, text[4], "p"), (5, "", "p")]
    rows += [(5, "", "p"), (None, None, "p"), (9, text[3] + " x y", "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("_key", mix.F.lit(1))
    got = jaccard.one_of_each(docs)
    assert got.columns == docs.columns
    left = Counter((r["doc_id"], r["text"]) for r in got.collect())
    third = [k for k in left if k[0] == 3]
    assert len(third) == 1 and third[0][1] in (text[2], near[2]) and left.pop(third[0]) == 1
    assert left == {
        (1, text[0]): 1, (2, text[1]): 1, (5, text[4]): 1, (5, ""): 2, (None, None): 1, (9, text[3] + " x y"): 1,
    }


def test_ngrams_tell_sets_apart():
    grams = lambda t: jaccard.ngrams(t).tolist()
    assert grams("A b\tc\nd  e f") == grams("a B c d e\x0bf") and len(grams("a b c d e f")) == 2
    assert grams("a b") != grams("ab") and grams("a b") != grams("b a") and len(grams("a b")) == 1
    assert grams("É b") != grams("é b") and grams(None) == grams("") == grams(" \n") == []
    assert len(grams("a b c d e " * 50)) == 5


# ---------------------------------------------------------------- personal data

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"


def test_emails_equal_the_pattern():
    rng = np.random.default_rng(9)
    for _ in range(3000):
        text = "".join(rng.choice(list("ab.@-_ é"), rng.integers(0, 25)))
        assert list(pii.emails(text)) == [m.span() for m in re.finditer(EMAIL, text)]


def test_base_spans_equal_the_patterns():
    rng = np.random.default_rng(10)
    for _ in range(3000):
        text = "".join(rng.choice(list("0123456789.. -+()x"), rng.integers(0, 45)))
        want = []
        for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
            if max(map(int, m.group().split("."))) <= 255:
                want.append((m.start(), 1, m.end()))
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
            d = re.sub("[^0-9]", "", m.group())
            odd = sum(int(c) for c in d[-1::-2]) + sum(sum(divmod(2 * int(c), 10)) for c in d[-2::-2])
            if 14 <= len(d) <= 19 and odd % 10 == 0:
                want.append((m.start(), 2, m.end()))
        for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
            if 10 <= len(re.findall("[0-9]", m.group())) <= 15:
                want.append((m.start(), 3, m.end()))
        assert pii.base_spans(text) == sorted(want)


def test_contexts_find_unseen_identifiers(spark):
    texts = [f"please write to u{i}@mail.example today" for i in range(9)]
    texts += ["please write to desk#42 today", "room 17 is free", "ask desk#42, please", None, "", LONG]
    got = {r["doc_id"]: r for r in pii.find(documents(spark, texts)).collect()}
    spans = lambda i: [(s["kind"], s["text"]) for s in got[i]["spans"]]
    assert spans(0) == [("email", "u0@mail.example")] and got[0]["base"] == got[0]["spans"]
    assert spans(9) == [("email", "desk#42")] and got[9]["base"] == []
    assert spans(10) == [] and spans(11) == [("email", "desk#42")] and spans(12) == spans(13) == spans(14) == []
    for i, row in got.items():
        assert all(texts[i][s["start"] : s["end"]] == s["text"] for s in row["spans"])


def test_unseen_numbers_with_spaces_come_back_whole(spark):
    texts = [f"please ring +1 (234) 567-890{i} now" for i in range(9)]
    texts += ["please ring 0171 555 1234 now", "0171 people, 555 of them in 1234", "ask 0171 555 1234 24/7", "in 0171, 555 1234"]
    got = {r["doc_id"]: r for r in pii.find(documents(spark, texts)).collect()}
    spans = [[(s["kind"], s["start"], s["text"]) for s in got[i]["spans"]] for i in range(len(texts))]
    assert spans[9] == [("phone", 12, "0171 555 1234")] and spans[11] == [("phone", 4, "0171 555 1234")]
    assert spans[10] == spans[12] == [] and got[9]["base"] == []
    runs = lambda text: [m[2] for m in pii.mentions(text, pii.base_spans(text))]
    assert runs("(0171) 555-12 - 34, x") == ["(0171) 555-12 - 34"] and runs("[1 2] 3 (4)") == ["[1 2] 3 (4)"]
    assert runs("1 2, 3 a@b 4\n5 six 7 1.2.3.4 8") == ["1 2", "3", "a@b", "4", "5", "7", "1.2.3.4", "8"]


def test_bootstrap_follows_long_chains(spark):
    """Six seeds make a context of two links confident only together with the score of the first of them."""
    rows = []

    def context(name, n, *unseen):
        rows.extend([(name, f"seed{i}", "email") for i in range(n)] + [(name, x, None) for x in unseen])

    context("start", 9, "link0")
    for k in range(1, 8):
        context(f"left {k}", 6, f"link{k - 1}", f"link{k}")
        context(f"both {k}", 6, f"link{k - 1}", f"link{k}")
    context("not enough", 4, "link7", "out", "out too")
    edges = spark.createDataFrame(rows, "context string, instance string, kind string")
    got = {r["instance"]: r["kind"] for r in pii.bootstrapped(edges).collect()}
    assert got == {f"link{k}": "email" for k in range(8)}


def test_pii_summary_and_edges(spark, edges):
    docs = documents(spark, ["é x@y.zz 1.2.3.4 card 4111 1111 1111 1111 +1 (234) 567-8901", "1.2.3.400"])
    got = {r["doc_id"]: r for r in pii.summary(pii.find(docs)).collect()}
    text = "email:2:8,ip:9:16,card:22:41,phone:42:59"
    assert got[0]["spans"] == text and got[0]["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert [got[0][f"n_{k}"] for k in pii.KINDS] == [1, 1, 1, 1] and got[1]["n_ip"] == 0
    assert pii.summary(pii.find(edges.withColumn("row", mix.F.lit(1)))).count() == len(EDGES)
    assert pii.find(edges.limit(0)).count() == 0
    assert pii.summary(pii.find(docs.union(docs))).count() == 4


# ---------------------------------------------------------------- columns and ids that clash


INTERNAL = ["_fp", "_drops", "_lines", "_figures", "_doc", "_key", "_text", "fp", "keys", "a.b", "lines", "n", "x"]


def test_other_columns_stay_whatever_their_names(spark):
    lines_ = "\n".join(["a shared line of words", "and one of its own"])
    docs = documents(spark, [f"{lines_} {i}" for i in range(12)] + [None, ""])
    clash = docs
    for i, name in enumerate(INTERNAL):
        clash = clash.withColumn(name, mix.F.lit(i))
    quoted = [mix.F.col(f"`{c}`") for c in INTERNAL]
    same = list(range(len(INTERNAL)))
    for made, key in (
        (lines.drop_frequent_lines(clash), ["n_lines", "n_dropped", "text"]),
        (rules.judge(clash), ["n_words", "failed", "kept"]),
        (mix.mixed(clash), ["text"]),
        (jaccard.one_of_each(clash), ["text"]),
    ):
        assert made.count() > 0 and {tuple(r) for r in made.select(*quoted).collect()} == {tuple(same)}
        assert set(key) <= set(made.columns)
    plain = sorted(lines.drop_frequent_lines(docs).select("doc_id", "text", "n_dropped").collect())
    assert sorted(lines.drop_frequent_lines(clash).select("doc_id", "text", "n_dropped").collect()) == plain
    assert [r["n_dropped"] for r in plain] == [1] * 12 + [0, 0]


def test_rows_of_one_id_are_documents_of_their_own(spark):
    import duckdb

    from biomeframe.llm import sql

    rows = [(7, f"often\nonly {i}") for i in range(10)] + [(None, "Often \nx"), (8, "rare\nrare"), (8, "rare")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = lines.drop_frequent_lines(docs).selectExpr("doc_id", "n_lines", "n_dropped", "sha2(text, 256)").collect()
    con = duckdb.connect()
    con.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    want = con.execute(sql.LINES).fetchall()
    key = lambda r: str(tuple(r))
    assert sorted(map(key, got)) == sorted(map(key, want)) and sum(r["n_dropped"] for r in got) == 11


# ---------------------------------------------------------------- decoding and graph scores by brute force


def test_decoding_equals_a_search_for_the_nearest_codeword():
    rng = np.random.default_rng(11)
    for languages in (2, 3, 5):
        bits = 2 ** (languages - 1) - 1
        codes = np.where(rng.random((languages, bits)) < 0.5, -1, 1)
        codes[0] = -codes[1]
        model = language.Model([f"l{i}" for i in range(languages)], codes, rng.normal(size=(6, bits)), rng.random(bits))
        x = rng.normal(size=(40, 6))
        got, score, close = language.decode(model, x)
        for row, best, share, unsure in zip(x, got, score, close, strict=True):
            losses = []
            for code in codes:
                loss = 0.0
                for j in range(bits):
                    margin = language.SCALE * sum(row[f] * model.weights[f, j] for f in range(6))
                    loss += model.trust[j] * np.log1p(np.exp(-margin * code[j]))
                losses.append(loss)
            shares = [1 / sum(np.exp(a - b) for b in losses) for a in losses]
            assert shares[best] == pytest.approx(max(shares)) and share == pytest.approx(max(shares))
            assert best == min(i for i, s in enumerate(shares) if s == pytest.approx(max(shares)))
            assert unsure == (sorted(shares)[-2] > language.AMBIGUOUS * max(shares))


def brute_bootstrap(edges, min_support, min_context, min_instance):
    seeds = {(i, k) for _, i, k in edges if k}
    members = defaultdict(set)
    for context, instance, _ in edges:
        members[context].add(instance)
    wide = {c for c, m in members.items() if len(m) >= min_support}
    unseen = {i for _, i, _ in edges} - {i for i, _ in seeds}
    found = {}
    while True:
        scores = dict.fromkeys(seeds, 1.0) | found
        sure = {}
        for c in wide:
            for k in {k for _, k in scores}:
                total = sum(s for (i, kind), s in scores.items() if kind == k and i in members[c])
                if total >= min_support and total / (len(members[c]) + 1) >= min_context:
                    sure[c, k] = total / (len(members[c]) + 1)
        new = {}
        for i in unseen:
            for k in {k for _, k in sure}:
                miss = [1 - p for (c, kind), p in sure.items() if kind == k and i in members[c]]
                if miss:
                    new[i, k] = 1 - np.prod(miss)
        still = all(s - found.get(x, 0.0) <= pii.STILL for x, s in new.items())
        found = new
        if still:
            break
    best = {}
    for (i, k), s in found.items():
        if s >= min_instance:
            best[i] = max(best.get(i, (0.0, 0, "")), (round(s, 12), -pii.KINDS.index(k), k))
    return {i: b[2] for i, b in best.items()}


def test_bootstrap_equals_brute_force(spark):
    rng = np.random.default_rng(7)
    accepted = 0
    for _ in range(4):
        kinds = {f"i{n}": str(rng.choice(pii.KINDS[:2])) if rng.random() < 0.5 else None for n in range(30)}
        edges = {(f"c{rng.integers(0, 14)}", i, kinds[i]) for i in rng.choice(list(kinds), 130)}
        table = spark.createDataFrame([tuple(map(lambda v: None if v is None else str(v), e)) for e in edges], "context string, instance string, kind string")
        how = {"min_support": 2.0, "min_context": 0.3, "min_instance": 0.5}
        got = {r["instance"]: r["kind"] for r in pii.bootstrapped(table, **how).collect()}
        assert got == brute_bootstrap(edges, **how)
        accepted += len(got)
    assert accepted > 10
