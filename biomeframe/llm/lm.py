"""Log probabilities of texts by a weighted backoff automaton over word n-grams.

Model: unigrams are (c + 1/2) / (N + (V + 1) / 2), unknown words c = 0. An n-gram h w has
(c(h w) + ``strength`` * p(w | shorter h)) / (c(h) + ``strength``), so what is unseen after h costs the
weight strength / (c(h) + strength) and backs off; each history's probabilities add up to one. As an
automaton, each n-gram seen in training is a state (its last word read), each seen continuation an arc
with its log probability, and each state has a failure arc with its backoff weight to the state of its
shorter history. A text is read once from left to right: the state is carried along, arcs and failure arcs add up.

Counting and answering are one exchange. Texts are coded in blocks of about ``BLOCK_TOKENS`` tokens: local word
numbers, and 64-bit keys of the distinct n-grams with their number in the block's training texts.
Blocks send each key once to the shard of its hash (sorted, as differences of keys); the shard adds up what all blocks sent
and answers each block in the order it asked. So a block gets exactly the part of the automaton that its texts can
touch, counted over the whole corpus; nothing is pruned, and neither the driver nor a task holds the model. What
is exchanged grows with the input; what the driver gets are three sums.

Skew: a block sends a frequent n-gram once, so a shard reads it as often as there are blocks, not
occurrences. Shards hold about ``SHARD_KEYS`` keys. A text is never cut, so the longest one bounds a block from below.

Defined results: null text is the empty text, which has the end token only; a null id counts as the empty
text where ids decide on training; repeated ids and rows are texts of their own; without training
texts every token is unknown and p is 1; an empty table gives no rows; only the id and text columns are read, so
others cannot clash; keys of different n-grams are taken as equal with a chance of 2^-64 a pair.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biomeframe.llm.common import arrow_rows
from biomeframe.session import LARGE_ROWS, materialise

ORDER, STRENGTH = 2, 200.0
# Sizes that bound a task's memory: an automaton takes about 250 bytes per n-gram of a block, a shard 100 per key.
BLOCK_TOKENS = 200_000
SHARD_KEYS = 1_000_000
BATCH_TEXTS, BATCH_BLOCKS = 512, 4
END, START = 0, 1
BITS = 32


# ---------------------------------------------------------------- numbers as bytes


def planes(numbers: np.ndarray) -> bytes:
    """Numbers as bytes of equal rank side by side: the high ones are mostly zero and compress away."""
    return numbers.view(np.uint8).reshape(len(numbers), numbers.itemsize).T.tobytes()


def numbers(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    """Ascending unsigned keys as their differences."""
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(numbers(data, np.uint64), dtype=np.uint64)


# ---------------------------------------------------------------- coded texts


def word_key(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Keys of n-grams from the keys of all but the last word and of the last word."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def coded(docs: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Rows ``doc_id, training, text`` as blocks: block, ids, training, lengths, tokens, words, train_tokens, n_tokens.

    ``tokens`` are local numbers, each text's with its end; ``words`` their keys.
    """
    id_type = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0

        def fresh() -> tuple:
            local: defaultdict = defaultdict()
            local.default_factory = local.__len__
            _ = local[b"\n"], local[b"\r"]  # no words: the end and the start
            return local, [], [], []

        def block() -> pa.RecordBatch:
            nonlocal made
            lengths = np.array([len(t) for t in tokens], np.uint32)
            flags = np.array(training, bool)
            columns = [
                pa.array([(task << 32) + made], pa.int64()),
                pa.array([ids], pa.list_(id_arrow)),
                pa.array([training], pa.list_(pa.bool_())),
                pa.array([planes(lengths)], pa.binary()),
                pa.array([planes(np.concatenate(tokens))], pa.binary()),
                pa.array([np.array([word_key(w) for w in local], np.uint64).tobytes()], pa.binary()),
                pa.array([int(lengths[flags].sum())], pa.int64()),
                pa.array([int(lengths.sum())], pa.int64()),
            ]
            made += 1
            # The dictionary and its factory hold each other: without this all words stay until a garbage collection.
            local.default_factory = None
            names = ["block", "ids", "training", "lengths", "tokens", "words", "train_tokens", "n_tokens"]
            return pa.RecordBatch.from_arrays(columns, names=names)

        local, ids, training, tokens = fresh()
        held, id_arrow = 0, None
        for batch in batches:
            id_arrow = batch.column(0).type
            for i, train, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                numbered = [local[w] for w in (text or b"").lower().split()]
                numbered.append(END)
                ids.append(i)
                training.append(train)
                tokens.append(np.array(numbered, np.uint32))
                held += len(numbered)
                if held >= block_tokens:
                    yield block()
                    local, ids, training, tokens = fresh()
                    held = 0
        if ids:
            yield block()

    schema = (
        f"block long, ids array<{id_type.simpleString()}>, training array<boolean>, lengths binary, tokens binary,"
        " words binary, train_tokens long, n_tokens long"
    )
    # As bytes: lower() and split() of bytes know ASCII letters and white space only.
    return docs.select("doc_id", "training", F.col("text").cast("binary")).mapInArrow(run, schema)


class Grams:
    """The distinct n-grams of a block, order by order.

    ``at[m]`` is the number of the n-gram of m words that ends at each token (-1 where the text has
    fewer words before it); ``prefix[m]``, ``last[m]`` and ``suffix[m]`` take an n-gram apart.
    """

    def __init__(self, tokens: np.ndarray, lengths: np.ndarray, words: np.ndarray, order: int):
        ends = np.cumsum(lengths)
        # Each text with its start in front.
        whole = np.insert(tokens.astype(np.int64), ends - lengths, START)
        place = np.arange(len(whole)) - np.repeat(ends - lengths + np.arange(len(lengths)), lengths + 1)
        self.whole, self.place = whole, place
        self.at = [None, whole]
        self.keys = [None, words]
        self.last, self.prefix, self.suffix = [None, np.arange(len(words))], [None, None], [None, None]
        for m in range(2, order + 1):
            shorter = self.at[m - 1]
            before = np.concatenate([[-1], shorter[:-1]])
            fits = np.flatnonzero((place >= m - 1) & (before >= 0))
            codes, first, inverse = np.unique((before[fits] << BITS) | whole[fits], return_index=True, return_inverse=True)
            at = np.full(len(whole), -1, np.int64)
            at[fits] = inverse
            self.at.append(at)
            self.prefix.append(codes >> BITS)
            self.last.append(codes & ((1 << BITS) - 1))
            self.suffix.append(shorter[fits[first]])
            self.keys.append(mixed(self.keys[m - 1][codes >> BITS], words[codes & ((1 << BITS) - 1)]))

    def train_counts(self, m: int, training: np.ndarray) -> np.ndarray:
        """Occurrences of each n-gram of m words in the training texts, starts aside."""
        at = self.at[m]
        use = training & (at >= 0) & (self.place >= (1 if m == 1 else m - 1))
        return np.bincount(at[use], minlength=len(self.keys[m]))


def _grams(row: dict, order: int) -> tuple[Grams, np.ndarray, np.ndarray]:
    tokens, lengths = numbers(row["tokens"], np.uint32), numbers(row["lengths"], np.uint32).astype(np.int64)
    training = np.repeat(np.array(row["training"], bool), lengths + 1)
    return Grams(tokens, lengths, np.frombuffer(row["words"], np.uint64), order), training, lengths


# ---------------------------------------------------------------- exchange


def _shard_starts(keys: np.ndarray, shards: int) -> np.ndarray:
    """First place of each shard in ascending keys; shards are equal ranges of the high half."""
    edges = (np.arange(shards + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(shards)
    return np.searchsorted(keys >> np.uint64(32), edges)


def asked(blocks: DataFrame, order: int, shards: int) -> DataFrame:
    """shard, block, m, keys, counts: each block's distinct n-grams with their training counts there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                grams, training, _ = _grams(row, order)
                for m in range(1, order + 1):
                    counts = grams.train_counts(m, training)
                    by_key = np.argsort(grams.keys[m])
                    keys, counts = grams.keys[m][by_key], counts[by_key].astype(np.uint32)
                    starts = _shard_starts(keys, shards)
                    full = np.flatnonzero(np.diff(starts))
                    spans = [slice(starts[s], starts[s + 1]) for s in full]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "shard": full.tolist(),
                            "block": [row["block"]] * len(full),
                            "m": [m] * len(full),
                            "keys": [packed_keys(keys[s]) for s in spans],
                            "counts": [planes(counts[s]) for s in spans],
                        }
                    )

    return blocks.mapInArrow(run, "shard long, block long, m long, keys binary, counts binary")


def _answers(rows: pa.Table) -> pa.Table:
    """Sums over all blocks for each block's keys, in the order asked, and the number of words seen in training."""
    sizes = np.array([len(x) // 8 for x in rows.column("keys").to_pylist()], np.int64)
    keys = np.concatenate([unpacked_keys(x) for x in rows.column("keys").to_pylist()])
    counts = np.concatenate([numbers(x, np.uint32) for x in rows.column("counts").to_pylist()])
    distinct, inverse = np.unique(keys, return_inverse=True)
    sums = np.bincount(inverse, weights=counts, minlength=len(distinct)).astype(np.uint64)
    totals = np.split(sums[inverse], np.cumsum(sizes)[:-1])
    m = rows.column("m").to_numpy()
    words = np.unique(inverse[np.repeat(m == 1, sizes)])
    types = np.zeros(len(sizes), np.int64)
    types[0] = int((sums[words] > 0).sum())
    return pa.table(
        {
            "block": rows.column("block"),
            "m": rows.column("m"),
            "shard": rows.column("shard"),
            "totals": pa.array([planes(t) for t in totals], pa.binary()),
            "types": pa.array(types),
        }
    )


# ---------------------------------------------------------------- automaton


class Automaton:
    """States and arcs for the n-grams of one block, with the counts of the whole corpus.

    State 0 is the empty history. Arcs are found by state and word; what a state has no arc for goes
    over its failure arc to the state of the shorter history.
    """

    def __init__(self, grams: Grams, totals: list[np.ndarray], n: int, types: int, order: int, strength: float):
        seen = totals[1].astype(float)
        self.unigram = (seen + 0.5) / (n + 0.5 * (types + 1))
        probability = [None, self.unigram]
        self.fail, self.backoff = [0], [0.0]
        # State of each n-gram; only those that can be followed are histories.
        state = [None]
        for m in range(1, order):
            counts = totals[m].copy()
            if m == 1:
                counts[START] = totals[1][END]  # every training text has one start and one end
            live = np.flatnonzero((counts > 0) & (grams.last[m] != END))
            own = np.zeros(len(counts), np.int64)
            own[live] = len(self.fail) + np.arange(len(live))
            shorter = state[m - 1][grams.suffix[m][live]] if m > 1 else np.zeros(len(live), np.int64)
            self.fail += shorter.tolist()
            self.backoff += np.log10(strength / (counts[live] + strength)).tolist()
            state.append(own)
            totals = [*totals[:m], counts, *totals[m + 1 :]]
        next_of_word = state[1] if order > 1 else np.zeros(len(seen), np.int64)
        # Arcs of the empty history: every word of the block, known or not.
        codes, weights, targets = [np.arange(len(seen))], [np.log10(self.unigram)], [next_of_word]
        for m in range(2, order + 1):
            counts = totals[m].astype(float)
            known = np.flatnonzero(counts > 0)
            history, last, suffix = grams.prefix[m][known], grams.last[m][known], grams.suffix[m][known]
            below = probability[m - 1][suffix]
            p = np.zeros(len(counts))
            p[known] = (counts[known] + strength * below) / (totals[m - 1][history] + strength)
            probability.append(p)
            after = state[m][known] if m < order else state[m - 1][suffix]
            codes.append((state[m - 1][history] << BITS) | last)
            weights.append(np.log10(p[known]))
            targets.append(after)
        self.arcs = {code: arc for arc, code in enumerate(np.concatenate(codes).tolist())}
        self.weight, self.target = np.concatenate(weights).tolist(), np.concatenate(targets).tolist()
        self.start = int(state[1][START]) if order > 1 else 0

    def score(self, tokens: list[int]) -> float:
        """Log10 probability of a text, read once from left to right."""
        find, fail, backoff, weight, target = self.arcs.get, self.fail, self.backoff, self.weight, self.target
        state, total = self.start, 0.0
        for word in tokens:
            arc = find((state << BITS) | word)
            while arc is None:
                total += backoff[state]
                state = fail[state]
                arc = find((state << BITS) | word)
            total += weight[arc]
            state = target[arc]
        return total


def score(
    docs: DataFrame,
    training: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    order: int = ORDER,
    strength: float = STRENGTH,
    block_tokens: int = BLOCK_TOKENS,
    shard_keys: int = SHARD_KEYS,
) -> DataFrame:
    """doc_id, training, n_tokens, n_known, train_tokens, base_score and score of every text.

    ``training`` is a condition on ``doc_id``. ``base_score`` is that of the unigrams alone, both in log10.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("training", F.coalesce(training, F.lit(False)))
    spark, id_type = rows.sparkSession, rows.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {id_type}, training boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
    with arrow_rows(spark, BATCH_TEXTS):
        blocks = materialise(coded(rows, block_tokens), **LARGE_ROWS)
    size = blocks.agg(F.sum("n_tokens").alias("all"), F.sum("train_tokens").alias("train")).first()
    if not size["all"]:
        return spark.createDataFrame([], schema)
    shards = max(1, -(-size["all"] * order // shard_keys))
    # Few blocks, or requests of blocks, at a time between Spark and its Python workers.
    with arrow_rows(spark, BATCH_BLOCKS):
        requests = asked(blocks, order, shards)
        told = materialise(
            requests.groupBy("shard").applyInArrow(_answers, "block long, m long, shard long, totals binary, types long")
        )
    n, types = size["train"], told.agg(F.sum("types")).first()[0]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = {c: left.column(c)[0].as_py() for c in left.column_names}
        grams, _, lengths = _grams(row, order)
        by_order = sorted(right.drop_columns(["types"]).to_pylist(), key=lambda r: (r["m"], r["shard"]))
        totals = [None]
        for m in range(1, order + 1):
            sums = np.concatenate([numbers(r["totals"], np.uint64) for r in by_order if r["m"] == m])
            own = np.empty(len(sums), np.int64)
            own[np.argsort(grams.keys[m])] = sums
            totals.append(own)
        automaton = Automaton(grams, totals, n, types, order, strength)
        tokens = numbers(row["tokens"], np.uint32)
        text_of = np.repeat(np.arange(len(lengths)), lengths)
        base = np.bincount(text_of, np.log10(automaton.unigram)[tokens], len(lengths))
        known = np.bincount(text_of, totals[1][tokens] > 0, len(lengths))
        starts = np.cumsum(lengths) - lengths
        scores = [automaton.score(tokens[a : a + k].tolist()) for a, k in zip(starts, lengths, strict=True)]
        return pa.table(
            {
                "doc_id": left.column("ids").combine_chunks().flatten(),
                "training": left.column("training").combine_chunks().flatten(),
                "n_tokens": pa.array(lengths),
                "n_known": pa.array(known.astype(np.int64)),
                "train_tokens": pa.array(np.full(len(lengths), n, np.int64)),
                "base_score": pa.array(base),
                "score": pa.array(np.array(scores, float)),
            }
        )

    sent = blocks.select("block", "ids", "training", "lengths", "tokens", "words")
    return sent.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run, schema)
