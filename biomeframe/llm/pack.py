"""Packing by minimum bin slack.

A document's ids are cut at every full window; what remains is shorter than a
window and goes to the task's pool. Each window takes the longest remainder and
the multiset of other remainders that comes closest to the capacity, found by a
subset-sum bitset over the pooled lengths and backtracked to counts per length.
Pools are bounded, so a task's memory does not depend on its input, nothing is
shuffled, and a lost task is simply run again.

Defined results: null text is the empty text (one end id); repeated rows are
packed once per row; a very long text is cut at every full window; of equal remainders the one
put into the pool last is taken first; an empty table gives no pieces; only the id and the text
column are read, so other columns cannot clash.
"""

from __future__ import annotations

import os
from bisect import bisect_left, insort
from codecs import charmap_decode
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from biomeframe.llm.common import arrow_rows, give_back
from biomeframe.session import materialise

WINDOW = 2048
POOL_TOKENS = 1_000_000
VOCABULARY = "word_bpe_49k.json"
# Texts that ``stored`` sends to a Python worker at a time; the JVM holds a batch two or three times outside its heap.
BATCH_ROWS = 1000
# Bytes of text whose distinct words are looked for together.
SLICE = 16_000_000
# Bytes of parts of words and their ids kept per Python worker; a full store is emptied.
KNOWN_BYTES = 24_000_000
# Parts of words per call of the tokenizer.
CALL = 20_000
# White space other than blanks.
SPACES = r"[\x09-\x0d\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
# Words whose lower case or composition may not be that of single characters.
WIDE = r"[^\x00-\x{24f}]|İ"
# The vocabulary's parts of a word other than runs of letters.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{N}|[^\s\p{L}\p{N}]+"


class Remembered:
    """The ids that ``make`` gives for distinct keys, made once and kept up to KNOWN_BYTES. An empty key has none."""

    def __init__(self, make: Callable[[pa.Array], pa.Array]):
        self.make = make
        self.forget()

    def forget(self) -> None:
        self.keys, self.ids = pa.array([""], pa.large_string()), pa.array([b""], pa.large_binary())

    def __call__(self, keys: pa.Array) -> pa.Array:
        at = pc.index_in(keys, value_set=self.keys)
        new = at.is_null()
        fresh = keys.filter(new)
        ids = pa.concat_arrays([self.ids, self.make(fresh)])
        out = ids.take(pc.replace_with_mask(at, new, pa.array(np.arange(len(self.keys), len(ids)), pa.int32())))
        self.keys, self.ids = pa.concat_arrays([self.keys, fresh]), ids
        if self.keys.nbytes + self.ids.nbytes > KNOWN_BYTES:
            self.forget()
        return out


class WordIds:
    """Ids of white-space separated words as little-endian uint32 bytes.

    The vocabulary's own splitting never crosses white space, so a text's ids
    are those of its words. Arrow finds the distinct words of many texts and cuts
    them into the vocabulary's parts; only distinct parts go to the merge table, many in
    one call. Words with other than Latin letters take the whole tokenizer.
    """

    def __init__(self, path: str | None):
        # Spark deals the cores.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(VOCABULARY)
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        # The same merges for parts between blanks. Printable bytes stand for themselves, the others for code points from 256 on.
        self.merges = Tokenizer(self.model)
        self.merges.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)} | {32: " "}
        self.letters = "".join(rest.get(b, chr(b)) for b in range(256))
        # The last token of a part bears the suffix, and no other: parts hold no "<" beside a letter.
        vocabulary, suffix = self.whole.get_vocab(), self.model.end_of_word_suffix
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self.part_ids = Remembered(self.merged)
        self.wide_ids = Remembered(lambda words: pa.array([self.encoded(w) for w in words.to_pylist()], pa.large_binary()))

    def merged(self, parts: pa.Array) -> pa.Array:
        made = [pa.array([], pa.large_binary())]
        for start in range(0, len(parts), CALL):
            some, _ = charmap_decode(" ".join(parts[start : start + CALL].to_pylist()).encode(), "strict", self.letters)
            (found,) = self.merges.encode_batch_fast([some], add_special_tokens=False)
            ids = np.array(found.ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != some.count(" ") + 1:
                # A vocabulary without a suffix does not tell where a part ends.
                each = [[t.id for t in self.model.tokenize(part)] for part in some.split(" ")]
                ids, ends = np.array([i for e in each for i in e], "<u4"), np.cumsum([len(e) for e in each])
            made.append(binary(np.concatenate([[0], ends]) * 4, pa.py_buffer(ids)))
        return pa.concat_arrays(made)

    def encoded(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def of_words(self, words: pa.Array) -> pa.Array:
        words = words.cast(pa.large_string())
        wide = pc.match_substring_regex(words, WIDE)
        lower = pc.utf8_lower(pc.if_else(wide, "", words))
        out = joined(lists_of(pc.replace_substring_regex(lower, PARTS, r" \0 "), self.part_ids))
        if pc.any(wide).as_py():
            out = pc.replace_with_mask(out, wide, self.wide_ids(words.filter(wide)))
        return out

    def of_texts(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text; a null one has none."""
        texts = texts.fill_null("")
        # Texts that may hold special strings.
        whole = pc.match_substring(texts, "<|")
        ids = joined(lists_of(pc.replace_substring_regex(pc.if_else(whole, "", texts), SPACES, " "), self.of_words))
        for i, alone in enumerate(whole.to_pylist()):
            yield self.encoded(texts[i].as_py()) if alone else ids[i].as_py()

    def of(self, text: str) -> bytes:
        return next(self.of_texts(pa.array([text])))


@lru_cache(maxsize=1)
def word_ids(path: str | None) -> WordIds:
    """One per Python worker: its next tasks go on with the vocabulary and the parts it knows."""
    words = WordIds(path)
    give_back()
    return words


def lists_of(texts: pa.Array, ids_of: Callable[[pa.Array], pa.Array]) -> tuple[np.ndarray, pa.Array]:
    """For the words between blanks of each text: where its words begin and end, and the ids of all words."""
    # Not utf8_split_whitespace: it reads on behind the last text and at times leaves that one's blanks.
    words = pc.split_pattern(texts, " ")
    coded = words.values.dictionary_encode()
    return words.offsets.to_numpy(), ids_of(coded.dictionary).take(coded.indices)


def joined(lists: tuple[np.ndarray, pa.Array]) -> pa.Array:
    """The ids of each text in one piece: those of its words follow one another as they are."""
    offsets, ids = lists
    _, ends, data = ids.buffers()
    return binary(np.frombuffer(ends, "<i8", len(ids) + 1)[offsets] if len(ids) else offsets * 0, data)


def binary(offsets: np.ndarray, data: pa.Buffer) -> pa.Array:
    buffers = [None, pa.py_buffer(offsets.astype("<i8")), data]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, buffers)


def slices(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``size`` bytes of text."""
    total = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype("i8") + 1)
    start = 0
    while start < len(total):
        before = total[start - 1] if start else 0
        stop = max(int(np.searchsorted(total, before + size, "right")), start + 1)
        yield start, stop
        start = stop


def best_fill(counts: dict[int, int], lengths: list[int], room: int) -> list[int]:
    """Lengths, repeats allowed up to ``counts``, whose sum comes closest to ``room`` from below.

    ``lengths`` are the keys of ``counts`` in ascending order. Bit s of ``reach``
    says that some multiset sums to s.
    """
    reach, mask, goal = 1, (1 << (room + 1)) - 1, 1 << room
    steps: list[tuple[int, int]] = []
    i = bisect_left(lengths, room + 1) - 1
    while i >= 0 and not reach & goal:
        length = lengths[i]
        for _ in range(min(counts[length], room // length)):
            grown = (reach | reach << length) & mask
            if grown == reach:
                break
            steps.append((length, reach))
            reach = grown
            if reach & goal:
                break
        i -= 1
    left, chosen = reach.bit_length() - 1, []
    for length, before in reversed(steps):
        if not before >> left & 1:
            chosen.append(length)
            left -= length
    return chosen


class Pool:
    """Remainders by length, and the windows made of them."""

    def __init__(self, window: int):
        self.window, self.tokens = window, 0
        self.stock: dict[int, list] = {}
        self.counts: dict[int, int] = {}
        self.lengths: list[int] = []

    def add(self, piece: tuple, length: int) -> None:
        if length not in self.counts:
            self.counts[length], self.stock[length] = 0, []
            insort(self.lengths, length)
        self.counts[length] += 1
        self.stock[length].append(piece)
        self.tokens += length

    def take(self, length: int) -> tuple:
        piece = self.stock[length].pop()
        self.counts[length] -= 1
        self.tokens -= length
        if not self.counts[length]:
            del self.counts[length], self.stock[length]
            del self.lengths[bisect_left(self.lengths, length)]
        return piece

    def window_pieces(self) -> list[tuple]:
        """One window: the longest remainder, the best multiset beside it, and, where that
        leaves slack, the head of one more remainder."""
        longest = self.lengths[-1]
        pieces, room = [self.take(longest)], self.window - longest
        for length in best_fill(self.counts, self.lengths, room) if room else ():
            pieces.append(self.take(length))
            room -= length
        if room and self.lengths:
            head, tail = split(self.take(self.lengths[-1]), room)
            pieces.append(head)
            self.add(tail, len(tail[2]) // 4)
        return pieces


def split(piece: tuple, at: int) -> tuple[tuple, tuple]:
    doc, start, ids, total = piece
    return (doc, start, ids[: 4 * at], total), (doc, start + at, ids[4 * at :], total)


def powers_of_two(pieces: list[tuple]) -> Iterator[list[tuple]]:
    """The last, unfilled window as sequences whose lengths are powers of two."""
    left = sum(len(p[2]) for p in pieces) // 4
    queue = pieces[::-1]
    while left:
        size = 1 << (left.bit_length() - 1)
        left -= size
        out = []
        while size:
            piece = queue.pop()
            length = len(piece[2]) // 4
            if length > size:
                piece, tail = split(piece, size)
                queue.append(tail)
                length = size
            out.append(piece)
            size -= length
        yield out


def sequences(docs: Iterator[tuple], window: int, pool_tokens: int) -> Iterator[list[tuple]]:
    """Lists of (doc, start, ids, doc_tokens), one list per sequence."""
    pool = Pool(window)
    for doc, ids in docs:
        total = len(ids) // 4
        whole = total - total % window
        for start in range(0, whole, window):
            yield [(doc, start, ids[4 * start : 4 * (start + window)], total)]
        if whole < total:
            pool.add((doc, whole, ids[4 * whole :], total), total - whole)
        if pool.tokens > pool_tokens:
            # Half stays, so that later windows still choose among many lengths.
            while pool.tokens > pool_tokens // 2:
                yield pool.window_pieces()
    while pool.tokens >= window:
        yield pool.window_pieces()
    rest = [pool.take(pool.lengths[-1]) for _ in range(sum(pool.counts.values()))]
    yield from powers_of_two(rest)


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    end_id: int = 1,
    tokenizer: str | None = None,
    pool_tokens: int = POOL_TOKENS,
) -> DataFrame:
    """Pieces with their ids: id, start, length, ids, doc_tokens, sequence_id, offset.

    ``ids`` are little-endian uint32. ``tokenizer`` is the path of a vocabulary
    file on the executors. Full sequences hold ``window`` ids; each task's last
    tokens form sequences of power-of-two lengths.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = StructType(
        [rows.schema["doc_id"]]
        + [StructField("start", LongType()), StructField("length", LongType()), StructField("ids", BinaryType())]
        + [StructField(c, LongType()) for c in ("doc_tokens", "sequence_id", "offset")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = word_ids(tokenizer), np.array([end_id], "<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 36
        kinds: list = []

        def texts() -> Iterator[tuple]:
            for batch in batches:
                kinds[:] = [batch.schema.field(0).type]
                docs, column = batch.columns
                for start, stop in slices(column, SLICE):
                    ids = words.of_texts(column[start:stop])
                    for doc, found in zip(docs[start:stop].to_pylist(), ids, strict=True):
                        yield doc, found + end
                    give_back()

        def batch(out: list[tuple]) -> pa.RecordBatch:
            types = [kinds[0], pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=schema.names)

        out: list[tuple] = []
        for pieces in sequences(texts(), window, pool_tokens):
            offset = 0
            for doc, start, ids, total in pieces:
                length = len(ids) // 4
                out.append((doc, start, length, ids, total, sequence, offset))
                offset += length
            sequence += 1
            if len(out) >= 2000:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    return rows.mapInArrow(run, schema)


def digests(pieces: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids instead of the ids."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def stored(docs: DataFrame, *columns: str, **how) -> DataFrame:
    """``digests`` of ``pack``, written once: only a job run here has small batches of texts."""
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        return materialise(digests(pack(docs, *columns, **how)))
