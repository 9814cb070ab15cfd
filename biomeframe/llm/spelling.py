"""Grouping of spelling variants: words one error apart, found with search schemes over FM-indexes.

Two words are near if they differ by one inserted, deleted or replaced code point. Cut a word
into halves: an error leaves one half as it is, so a near word of the same length or one longer
starts with the first half or ends with the second (shorter ones see the pair from
their side). Each word is therefore dealt by hash to the groups of the halves that it could share:
its own two halves, which it asks for, and the one half of another length that a shorter word
could ask for, three rows a word. A group builds a bidirectional FM-index over its delimited
words: suffix ranks of the text and of the reversed text, whose intervals are kept in step. All its words
are searched at the same time: the exact half (with the delimiter) is matched inwards, then the
search turns and runs over the other half, where one replacement or insertion may branch off to each symbol that the
interval still holds, up to the other delimiter. A pair that both halves find counts for the first half only.

Groups return one row per word that has a near word (how many, and the most frequent one), never pairs;
these rows are summed by word. Forms are followed by doubling: each round joins the map with itself.

Skew: a half that more than ``GROUP_ROWS`` rows share is cut into blocks by word; each block is searched by each
block of the words that ask, so tasks stay bounded and no word is left out. The rank tables take
at most ``TABLE_CELLS`` numbers, whatever the length of a word.

Defined results: null and empty words and null counts have no part; a repeated word counts with the sum of
its numbers; ties between near words go to the larger count, then to the smaller word in
code-point order; an empty table gives no rows; only the word and the count are read, so other columns cannot
clash. Words of one code point have an empty first half and are near each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biomeframe.llm.common import ascii_lower
from biomeframe.session import materialise

RUN = "[A-Za-zÀ-ÿ]"
MIN_LENGTH, MIN_COUNT, EVERY, TIMES = 7, 2, 31, 10
GROUP_CHARS, GROUP_ROWS = 200_000, 20_000
TABLE_CELLS = 16_000_000
QUERIES, PATTERN_CELLS = 8192, 2_000_000


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, every: int = EVERY) -> DataFrame:
    """``word`` of each run of letters in each text, A-Z lower-cased; every ``every``-th by hash loses a code point.

    The hash is the crc32 of ``<id>:<run>``; a null id counts as the empty text. Words of fewer than
    ``min_length`` code points are left out.
    """
    every_run = F.regexp_extract_all(F.col(text_col), F.lit(f"{RUN}{{{min_length},}}"), F.lit(0))
    each = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(every_run).alias("run"))
    run = F.col("run")
    found = each.select("id", ascii_lower(run).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    word = F.when(F.pmod(h, F.lit(every)) == 0, cut).otherwise(run)
    return found.select(word.alias("word")).filter(F.length("word") >= min_length)


def vocabulary(words: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """Distinct words with their occurrences ``n``, of those that occur at least ``min_count`` times."""
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


# ---------------------------------------------------------------- FM-index


def suffix_order(text: np.ndarray, bits: int) -> np.ndarray:
    """Start positions of the suffixes of ``text`` (symbols from 1) in order, by prefix doubling.

    The first round packs as many symbols as fit a long, so that short words need two or three rounds.
    """
    n = len(text)
    step = max(1, 62 // bits)
    padded = np.concatenate([text.astype(np.int64), np.zeros(step, np.int64)])
    key = np.zeros(n, np.int64)
    for i in range(step):
        key = (key << bits) | padded[i : i + n]
    while True:
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)]) + 1
        if n == 0 or rank[order[-1]] == n:
            return order
        after = np.zeros(n, np.int64)
        after[: max(0, n - step)] = rank[step:]
        key = rank * (n + 1) + after
        step *= 2


class Ranks:
    """Occurrences of symbols in prefixes of the Burrows-Wheeler text of one direction."""

    def __init__(self, text: np.ndarray, bits: int, sigma: int):
        self.order = suffix_order(text, bits)
        bwt = text[self.order - 1]
        self.step = max(1, -(-len(text) * (sigma + 1) // TABLE_CELLS))
        cells = np.zeros((len(text) // self.step + 2, sigma + 1), np.int32)
        np.add.at(cells, (np.arange(len(text)) // self.step + 1, bwt), 1)
        self.table = np.cumsum(cells, axis=0, dtype=np.int32)
        self.bwt = np.concatenate([bwt, np.zeros(self.step, bwt.dtype)])
        self.start = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma + 1))])[: sigma + 1]

    def rows(self, at: np.ndarray) -> np.ndarray:
        """Occurrences of every symbol before the places ``at``, one row each."""
        base = at // self.step
        out = self.table[base]
        for i in range(self.step - 1):
            place = base * self.step + i
            more = np.flatnonzero(place < at)
            out[more, self.bwt[place[more]]] += 1
        return out


class Index:
    """Bidirectional FM-index over delimited words; intervals are (place, place in the reversed text, size)."""

    def __init__(self, words: list[str]):
        joined = "\n" + "".join(w + "\n" for w in words)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        symbols = np.unique(points)
        # The delimiter sorts before every symbol of a word.
        self.symbols = np.concatenate([[10], symbols[symbols != 10]]).astype(np.uint32)
        self.by_point = np.argsort(self.symbols, kind="stable")
        text = self.codes(points)
        self.sigma = len(self.symbols)
        bits = int(self.sigma).bit_length()
        self.ways = (Ranks(text, bits, self.sigma), Ranks(text[::-1].copy(), bits, self.sigma))
        self.word_at = np.cumsum(text == 1) - 1
        self.n = len(text)

    def codes(self, points: np.ndarray) -> np.ndarray:
        """Symbols from 1; the delimiter is 1, what the index does not hold is 0."""
        at = np.searchsorted(self.symbols, points, sorter=self.by_point)
        code = self.by_point[np.minimum(at, len(self.by_point) - 1)]
        return np.where(self.symbols[code] == points, code + 1, 0).astype(np.int64)

    def children(self, way: int, place: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per interval and symbol: occurrences before the interval and inside it."""
        before = self.ways[way].rows(place)
        return before, self.ways[way].rows(place + size) - before

    def extend(self, way: int, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Intervals after one more symbol each, to the left (way 0) or to the right (way 1).

        ``state`` has the columns place, reversed place, size; empty intervals have size 0.
        """
        before, inside = self.children(way, state[:, way], state[:, 2])
        return self.taken(way, state, symbol, before, inside)

    def taken(self, way: int, state: np.ndarray, symbol: np.ndarray, before: np.ndarray, inside: np.ndarray) -> np.ndarray:
        at = np.arange(len(state))
        out = np.empty_like(state)
        out[:, way] = self.ways[way].start[symbol] + before[at, symbol]
        # In the other direction the interval is parted by the symbol just read.
        smaller = np.cumsum(inside, axis=1)[at, symbol] - inside[at, symbol]
        out[:, 1 - way] = state[:, 1 - way] + smaller
        out[:, 2] = inside[at, symbol]
        return out

    def words_of(self, way: int, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, word) for each occurrence in the intervals; a match ends at a delimiter."""
        rows = np.repeat(np.arange(len(state)), state[:, 2])
        first = np.repeat(state[:, way], state[:, 2])
        nth = np.arange(len(rows)) - np.repeat(np.cumsum(state[:, 2]) - state[:, 2], state[:, 2])
        at = self.ways[way].order[first + nth]
        # The delimiter just read stands before the word, or after it if the search went to the right.
        return rows, self.word_at[at] if way == 0 else self.word_at[self.n - 1 - at] - 1


def search(index: Index, words: list[str], first: bool) -> tuple[np.ndarray, np.ndarray]:
    """(query, word) of each indexed word that is one replacement or insertion away in the other half.

    The half matched exactly is the ``first`` one or else the second. Pairs come once each.
    """
    way = 1 if first else 0  # direction of the second part, the one with the error
    points = [np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in words]
    lengths = np.array([len(p) for p in points])
    halves = lengths // 2
    exact, rest = (halves, lengths - halves) if first else (lengths - halves, halves)
    pattern = np.zeros((len(words), max(1, int(lengths.max(initial=0)))), np.int64)
    for i, p in enumerate(points):
        codes = index.codes(p)
        # Outwards from the cut: the exact half to one side, the other half to the other.
        halves_out = (codes[: exact[i]][::-1], codes[exact[i] :]) if first else (codes[rest[i] :], codes[: rest[i]][::-1])
        pattern[i, : len(p)] = np.concatenate(halves_out)
    state = np.tile(np.array([[0, 0, index.n]], np.int64), (len(words), 1))
    ids = np.arange(len(words))
    for j in range(int(exact.max(initial=0)) + 1):
        open_ = np.flatnonzero((j <= exact[ids]) & (state[:, 2] > 0))
        symbol = np.where(j < exact[ids[open_]], pattern[ids[open_], np.minimum(j, pattern.shape[1] - 1)], 1)
        state[open_] = index.extend(1 - way, state[open_], symbol)
    alive = np.flatnonzero(state[:, 2] > 0)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    # Rows of the search: interval, query, symbols of the other half read, errors made.
    state, ids = state[alive], ids[alive]
    read, errors = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    while len(ids):
        at_end = read == rest[ids]
        column = np.minimum(exact[ids] + read, pattern.shape[1] - 1)
        symbol = np.where(at_end, 1, pattern[ids, column])
        before, inside = index.children(way, state[:, way], state[:, 2])
        straight = index.taken(way, state, symbol, before, inside)
        done = np.flatnonzero(at_end & (errors == 1) & (straight[:, 2] > 0))
        if len(done):
            rows, hits = index.words_of(way, straight[done])
            found.append((ids[done[rows]], hits))
        go = np.flatnonzero(~at_end & (straight[:, 2] > 0))
        parts = [(straight[go], ids[go], read[go] + 1, errors[go])]
        clean = np.flatnonzero(errors == 0)
        child = inside[clean].copy()
        child[:, :2] = 0  # a delimiter is no symbol of a word
        r, c = np.nonzero(child)
        rows = clean[r]
        if len(rows):
            branch = index.taken(way, state[rows], c, before[rows], inside[rows])
            # A symbol put before an equal one is the same word as after it: only the last place counts.
            other = c != symbol[rows]
            for use, step in ((other & ~at_end[rows], 1), (other, 0)):
                parts.append((branch[use], ids[rows[use]], read[rows[use]] + step, np.ones(int(use.sum()), np.int64)))
        state, ids, read, errors = (np.concatenate(x) for x in zip(*parts, strict=True))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([q for q, _ in found]), np.concatenate([w for _, w in found])


# ---------------------------------------------------------------- groups


def _best(word: np.ndarray, other: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Per word number: how many others, and the other of largest count, ties to the smaller number."""
    order = np.lexsort((other, -counts[other], word))
    word, other = word[order], other[order]
    heads, starts, sizes = np.unique(word, return_index=True, return_counts=True)
    return heads, sizes, other[starts]


def _parts(asking: np.ndarray, names: list[str]) -> Iterator[np.ndarray]:
    """Words to search at the same time: of like lengths, at most ``QUERIES`` words and ``PATTERN_CELLS`` symbols."""
    asking = asking[np.argsort([len(names[i]) for i in asking], kind="stable")]
    while len(asking):
        sizes = np.array([len(names[i]) for i in asking[:QUERIES]])
        fits = max(1, int((sizes * np.arange(1, len(sizes) + 1) <= PATTERN_CELLS).sum()))
        yield asking[:fits]
        asking = asking[fits:]


def _near_in_group(rows: pa.Table) -> pa.Table:
    """word, n_near, best_n, best of one group's words, from the searches of this group."""
    first = rows.column("first")[0].as_py()
    texts = rows.column("word").to_pylist()
    names = sorted(set(texts))
    number = {w: i for i, w in enumerate(names)}
    at = np.array([number[w] for w in texts], np.int64)
    counts = np.zeros(len(names), np.int64)
    counts[at] = rows.column("n").to_numpy()
    listed = np.unique(at[rows.column("indexed").to_numpy(zero_copy_only=False)])
    asking = np.unique(at[rows.column("asks").to_numpy(zero_copy_only=False)])
    word, other = [], []
    if len(listed) and len(asking):
        index = Index([names[i] for i in listed])
        for part in _parts(asking, names):
            q, hits = search(index, [names[i] for i in part], first)
            a, b = part[q], listed[hits]
            if not first:
                # The first half finds these too.
                keep = [not names[j].startswith(names[i][: len(names[i]) // 2]) for i, j in zip(a, b, strict=True)]
                a, b = a[keep], b[keep]
            longer = np.array([len(names[j]) > len(names[i]) for i, j in zip(a, b, strict=True)], bool)
            # A longer word is seen by the shorter one only, so it is told.
            word += [a, b[longer]]
            other += [b, a[longer]]
    empty = np.empty(0, np.int64)
    heads, sizes, best = _best(np.concatenate([empty, *word]), np.concatenate([empty, *other]), counts)
    return pa.table(
        {
            "word": pa.array([names[i] for i in heads], pa.string()),
            "n_near": pa.array(sizes, pa.int64()),
            "best_n": pa.array(counts[best], pa.int64()),
            "best": pa.array([names[i] for i in best], pa.string()),
        }
    )


def _dealt(words: DataFrame, shortest: int) -> DataFrame:
    """word, n, first, key and asks: the halves that a word asks for or that a shorter word could ask for."""
    w, size = F.col("word"), F.length("word")
    half = F.floor(size / 2).cast("int")
    entry = lambda first, length, asks: F.struct(
        F.lit(first).alias("first"),
        F.xxhash64(F.lit(first), F.substring(w, F.lit(1), length) if first else F.substring(w, size - length + 1, length)).alias("key"),
        F.lit(asks).alias("asks"),
    )
    own = F.array(entry(True, half, True), entry(False, size - half, True))
    shorter = F.floor((size - 1) / 2).cast("int")
    other = F.when(size % 2 == 0, entry(True, shorter, False)).otherwise(entry(False, size - 1 - shorter, False))
    every = F.when(size > shortest, F.concat(own, F.array(other))).otherwise(own)
    return words.select("word", "n", F.inline(every))


def near(words: DataFrame, group_chars: int = GROUP_CHARS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """word, n_near, best_n, best: how many words of the vocabulary are near, and the most frequent of them.

    ``words`` has distinct ``word`` with its number ``n``. Words without a near word give no row.
    """
    size = words.agg(F.sum(F.length("word") + 1).alias("chars"), F.min(F.length("word")).alias("least")).first()
    schema = "word string, n_near long, best_n long, best string"
    if not size["chars"]:
        return words.sparkSession.createDataFrame([], schema)
    buckets = max(1, -(-3 * size["chars"] // group_chars))
    rows = _dealt(words, size["least"])
    heavy = rows.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > group_rows)
    heavy = materialise(heavy.select("key", F.ceil(F.col("c") / group_rows).cast("int").alias("blocks")))
    rows = rows.join(heavy, "key", "left")
    at = F.pmod(F.xxhash64("word", F.lit(1)), F.coalesce("blocks", F.lit(1)).cast("long")).cast("int")
    place = lambda i, j, asks, indexed: F.struct(i.alias("i"), j.alias("j"), asks.alias("asks"), indexed.alias("indexed"))
    yes, no = F.lit(True), F.lit(False)
    lanes = F.sequence(F.lit(0), F.col("blocks") - 1)
    # Block i of the indexed words meets block j of the asking words.
    listed = F.transform(lanes, lambda j: place(F.col("at"), j, no, yes))
    asking = F.transform(lanes, lambda i: place(i, F.col("at"), yes, no))
    one = F.array(place(F.lit(0), F.lit(0), F.col("asks"), yes))
    spread = F.when(F.col("blocks").isNull(), one).when(F.col("asks"), F.concat(listed, asking)).otherwise(listed)
    group = F.when(F.col("blocks").isNull(), F.pmod("key", F.lit(buckets))).otherwise(F.col("key"))
    placed = rows.withColumn("at", at).select(
        "first", F.col("blocks").isNotNull().alias("heavy"), group.alias("group"), "word", "n", F.explode(spread).alias("p")
    )
    flat = placed.select("first", "heavy", "group", "p.*", "word", "n")
    parts = flat.groupBy("first", "heavy", "group", "i", "j").applyInArrow(_near_in_group, schema)
    top = F.min(F.struct((-F.col("best_n")).alias("o"), F.col("best").alias("w")))
    merged = parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), top.alias("top"))
    return merged.select("word", "n_near", (-F.col("top.o")).alias("best_n"), F.col("top.w").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last word reached from ``word`` over ``form``; the map must have no circle.

    A form outweighs its word by a factor, so a chain is as short as the logarithm of the largest
    count; every round halves what is left of it.
    """
    found = materialise(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = found.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        joined = found.join(onward, "root", "left")
        step = materialise(joined.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        found = step.select("word", "root")
        if step.filter("_moved").isEmpty():
            return found


def variants(words: DataFrame, word_col: str = "word", count_col: str = "n", times: float = TIMES, **grouping: int) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of a vocabulary with numbers.

    A word's form is its near word of largest number, where that is at least ``times`` the word's own;
    the root is the end of the chain of forms, the word itself if it has none.
    """
    named = words.select(F.col(word_col).alias("word"), F.col(count_col).cast("long").alias("n"))
    once = materialise(named.filter("length(word) > 0 AND n IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n")))
    searched = materialise(near(once, **grouping))
    formed = F.col("best_n") >= F.col("n") * F.lit(times)
    told = once.join(searched, "word", "left").select(
        "word",
        F.when(formed, F.col("best")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(formed, F.col("best_n")).alias("form_n"),
    )
    told = materialise(told)
    ends = roots(told.filter("form IS NOT NULL"))
    return told.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
