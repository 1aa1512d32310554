"""LM scoring: prediction by partial matching over a byte-context trie, and a smoothed word model as the base.

The trie of ORDER bytes of context is counted over all training texts: each node holds how often each byte (or the end of the
text) follows its context. The code length of a symbol is that of PPM: where the longest context has seen it, its share; else an
escape (method C: as likely as that context has different symbols) to the next shorter context, in which all symbols that the longer
one has seen are excluded, down to a uniform choice of what is left. With a trained trie the cost of a symbol depends on its ORDER
bytes of context only, so a cost is computed once for every distinct gram and looked up for the rest.

No model is broadcast but the contexts of two bytes and less, and no dictionary is held by the driver. Texts are dealt into blocks. A
block tells the parts of the trie and of the word list which grams and words it holds and how often its training texts have them,
packed, if it holds any; a part adds up what all blocks tell it, works out the costs, and answers each block in the order of its
question. Blocks and parts are as many as the texts need; a task takes several in turn, in order, and holds one at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm.common import fold, small_batches, texts, written
from sextant.llm.shingles import chunks, word_hashes

#: Bytes of context. A gram is a context and the symbol after it, in 8 * ORDER + 9 bits.
ORDER = 5
END, SYMBOLS = 256, 257
WORD_BIT = np.uint64(1 << 63)
#: Texts of one block, in bytes: what a task holds at once. The most partitions that blocks or parts are dealt to.
BLOCK_BYTES, MOST_TASKS = 16 << 20, 20_000
#: Bytes whose grams are sorted at once.
CHUNK = 1 << 20
BLANKS = re.compile(rb"[\x20\x09-\x0D]")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOG10 = np.log(10.0)


class Piece(NamedTuple):
    """A text, or a part of a long one: whose, the ORDER bytes before it, its bytes, and whether the text ends with it."""

    owner: int
    before: bytes
    text: bytes
    last: bool


def pieces(data: list[bytes]) -> list[Piece]:
    """Texts; one over CHUNK bytes in parts that end after white space, so that no word is cut (one without any stays whole)."""
    out = []
    for i, t in enumerate(data):
        at = 0
        while True:
            end = len(t)
            if end - at > CHUNK:
                cut = next((m.start() for m in BLANKS.finditer(t, at + CHUNK - 1)), end)
                end = min(end, cut + 1)
            out.append(Piece(i, t[max(0, at - ORDER) : at].rjust(ORDER, b"\0"), t[at:end], end == len(t)))
            if end == len(t):
                break
            at = end
    return out


def grams(own: list[Piece]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all symbols of all pieces in a row (context << 9 | symbol), and how many each has: its bytes and a text's end.

    A-Z count as a-z; before a text stand zero bytes.
    """
    raw = LOWER[np.frombuffer(b"".join(p.before + p.text + b"\0" for p in own), np.uint8)].astype(np.uint64)
    last = np.array([p.last for p in own])
    whole = np.array([len(p.text) + 1 for p in own], np.int64)
    size = whole - ~last
    keys = np.zeros(len(raw) - ORDER, np.uint64)
    for k in range(ORDER):
        keys = (keys << np.uint64(8)) | raw[k : k + len(keys)]
    keys = (keys << np.uint64(9)) | raw[ORDER:]
    begin = np.cumsum(whole + ORDER) - whole - ORDER
    at = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    keys = keys[at]
    keys[np.cumsum(size)[last] - 1] |= np.uint64(END)  # the symbol of the byte 0 after a text
    return keys, size


def words(own: list[Piece]) -> tuple[np.ndarray, np.ndarray]:
    hashed, count = word_hashes([p.text for p in own])
    return hashed | WORD_BIT, count


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Grams whose contexts end alike in three bytes share a part, so all orders from 3 on are there; words are dealt by hash."""
    tail = ((keys >> np.uint64(9)) & np.uint64(0xFFFFFF)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)
    return (np.where(keys >= WORD_BIT, keys, tail) % np.uint64(parts)).astype(np.int32)


def tally(data: list[bytes], learn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of the texts, ascending, and how often those with ``learn`` have each."""
    found = []
    for counts in (True, False):
        own = pieces([t for t, ok in zip(data, learn, strict=True) if bool(ok) == counts])
        for i, j in chunks([len(p.text) for p in own], CHUNK):
            for make in (grams, words):
                keys, n = np.unique(make(own[i:j])[0], return_counts=True)
                found.append((keys, n if counts else np.zeros_like(n)))
            if sum(len(k) for k, _ in found) > 4_000_000:
                found = [add_up(found)]
    return add_up(found)


def add_up(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys, count = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, count = keys[order], count[order]
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[begin], np.add.reduceat(count, begin) if len(begin) else count[:0]


class Level:
    """All contexts of one length: their symbols with counts, and what an escape from the longer context finds in them."""

    def __init__(self, keys: np.ndarray, count: np.ndarray) -> None:
        self.keys, self.count = keys, count  # context << 9 | symbol, ascending
        ctx = keys >> np.uint64(9)
        begin = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]])) if len(ctx) else np.zeros(0, np.int64)
        self.begin, self.contexts = begin, ctx[begin]
        self.total = np.add.reduceat(count, begin) if len(begin) else count[:0]
        self.kinds = np.diff(np.append(begin, len(keys)))

    def count_of(self, keys: np.ndarray) -> np.ndarray:
        return _lookup(self.keys, self.count, keys)

    def context(self, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place (0 where unseen), whether seen, total and kinds are read at the place."""
        at = np.minimum(np.searchsorted(self.contexts, contexts), max(0, len(self.contexts) - 1))
        return at, (self.contexts[at] == contexts) if len(self.contexts) else np.zeros(len(contexts), bool)

    def excluded(self, shorter: "Level", mask: np.uint64) -> np.ndarray:
        """Of each context: how often the next shorter one has the symbols that this one has seen."""
        own = shorter.count_of(((self.keys >> np.uint64(9)) & mask) << np.uint64(9) | (self.keys & np.uint64(511)))
        return np.add.reduceat(own, self.begin) if len(self.begin) else own[:0]


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted), values.dtype)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


Low = tuple[np.ndarray, np.ndarray]  # contexts of LOW bytes << 9 | symbol, ascending, and their counts
#: Bytes of the longest context that every task knows.
LOW = 2


def shorter(low: Low, k: int) -> Low:
    """Counts for contexts of ``k`` bytes from those of LOW."""
    mask = np.uint64((1 << 8 * k) - 1)
    return add_up([(((low[0] >> np.uint64(9)) & mask) << np.uint64(9) | (low[0] & np.uint64(511)), low[1])])


def costs(wanted: np.ndarray, keys: np.ndarray, count: np.ndarray, low: Low) -> np.ndarray:
    """log10 probability of each wanted gram, from counted grams (those of all their three-byte tails) and ``low``."""
    seen = count > 0
    levels: dict[int, Level] = {}
    mask = {k: np.uint64((1 << 8 * k) - 1) for k in range(ORDER + 1)}
    for k in range(ORDER, LOW, -1):
        cut = ((keys[seen] >> np.uint64(9)) & mask[k]) << np.uint64(9) | (keys[seen] & np.uint64(511))
        levels[k] = Level(*add_up([(cut, count[seen])]))
    for k in range(LOW, -1, -1):
        levels[k] = Level(*shorter(low, k))
    none = levels[0].keys
    excluded = {k: levels[k].excluded(levels[k - 1], mask[k - 1]) for k in range(ORDER, 0, -1)}
    out = np.zeros(len(wanted))
    left = np.arange(len(wanted))
    place, had = np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)  # of the next longer context
    symbol = wanted & np.uint64(511)
    context = wanted >> np.uint64(9)
    for k in range(ORDER, -1, -1):
        level = levels[k]
        at, ok = level.context(context[left] & mask[k])
        gone = had[left] if k < ORDER else np.zeros(len(left), bool)
        n = np.where(ok, level.total[at] if len(level.total) else 0, 0).astype(float)
        d = np.where(ok, level.kinds[at] if len(level.kinds) else 0, 0).astype(float)
        if k < ORDER and len(levels[k + 1].contexts):
            n -= np.where(gone, excluded[k + 1][place[left]], 0)
            d -= np.where(gone, levels[k + 1].kinds[place[left]], 0)
        c = np.where(ok, level.count_of((context[left] & mask[k]) << np.uint64(9) | symbol[left]), 0)
        hit = c > 0
        live = d > 0
        whole = np.where(live, n + d, 1.0)
        out[left] += np.log(np.where(hit, np.maximum(c, 1), np.where(live, d, 1.0)) / whole)
        place[left], had[left] = at, ok
        left = left[~hit]
    out[left] -= np.log(max(1, SYMBOLS - len(none)))
    return out / LOG10


def _low(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (LOW bytes before, symbol) in training texts; -1: bytes of all texts; -2: words of training texts."""
    found, size, n_words = [], 0, 0

    def out(keys: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(count.astype(np.int64))], ["k", "n"])

    for b in batches:
        data, learn = b.column(0).to_pylist(), b.column(1).to_pylist()
        size += sum(map(len, data))
        own = [t for t, ok in zip(data, learn, strict=True) if ok]
        for i, j in chunks([len(t) for t in own]):
            n_words += len(word_hashes(own[i:j])[0])
            raw = LOWER[np.frombuffer(b"".join(b"\0" * LOW + t for t in own[i:j]) + b"\0" * LOW, np.uint8)].astype(np.int64)
            keys = (raw[:-2] << 17 | raw[1:-1] << 9 | raw[2:]).astype(np.uint64)
            ends = np.cumsum([len(t) + LOW for t in own[i:j]])  # place of the first zero after each text
            symbol_at = ends - LOW
            keys[symbol_at] = (keys[symbol_at] >> np.uint64(9)) << np.uint64(9) | np.uint64(END)
            keep = np.ones(len(keys), bool)
            keep[symbol_at[symbol_at + 1 < len(keys)] + 1] = False  # between two texts
            values, n = np.unique(keys[keep], return_counts=True)
            found.append((values, n))
        if sum(len(k) for k, _ in found) > 400_000:
            found = [add_up(found)]
    keys, count = add_up(found)
    yield out(np.append(keys.astype(np.int64), [-1, -2]), np.append(count, [size, n_words]))


def _tell(parts: int) -> object:
    """Of each block, whose rows come together: for every part of which it has keys, these and their training counts."""

    def rows_of(block: int, rows: list[tuple[bytes, bool]]) -> Iterator[pa.RecordBatch]:
        keys, count = tally([t for t, _ in rows], np.array([ok for _, ok in rows], float))
        part = part_of(keys, parts)
        order = np.argsort(part, kind="stable")
        part, keys, count = part[order], keys[order], count[order].astype(np.int64)
        cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
        for i in range(0, len(cut), 64):
            own = cut[i : i + 64]
            ends = np.append(cut, len(part))[i + 1 : i + 1 + len(own)]
            spans = list(zip(own.tolist(), ends.tolist(), strict=True))
            row = [pa.array(part[own], pa.int32()), pa.array([block] * len(own), pa.int32()), pa.array([keys[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([count[a:b].tobytes() for a, b in spans], pa.binary())]
            yield pa.RecordBatch.from_arrays(row, ["part", "block", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for b in batches:
            for block, t, learn in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if block != at and held:
                    yield from rows_of(at, held)
                    held = []
                at = block
                held.append((t, learn))
        if held:
            yield from rows_of(at, held)

    return run


def _answer(low) -> object:
    """Of each part, whose rows come together: to each block, the values of its keys there: log10 cost of a gram, training count of a
    word. Block -1 gets how many different words the part has in training."""

    def rows_of(part: int, asked: list[tuple[int, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        own = [(k, np.frombuffer(a, np.uint64), np.frombuffer(c, np.int64)) for k, a, c in asked]
        keys, count = add_up([(a, c) for _, a, c in own])
        is_word = keys >= WORD_BIT
        value = count.astype(np.float64)
        value[~is_word] = costs(keys[~is_word], keys[~is_word], count[~is_word], low.value)
        replies = [(block, value[np.searchsorted(keys, a)].tobytes()) for block, a, _ in own] + [(-1, np.float64((count[is_word] > 0).sum()).tobytes())]
        for i in range(0, len(replies), 64):
            some = replies[i : i + 64]
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(some), pa.int32()), pa.array([k for k, _ in some], pa.int32()), pa.array([d for _, d in some], pa.binary())], ["part", "block", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for b in batches:
            for part, *rest in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
                if part != at and held:
                    yield from rows_of(at, held)
                    held = []
                at = part
                held.append(tuple(rest))
        if held:
            yield from rows_of(at, held)

    return run


COLUMNS = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(parts: int, ends: int, total: int, kinds) -> object:
    """A block's texts with its answers; ``ends`` training texts, whose ends are tokens too, ``total`` training words."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        data = left.column("t").to_pylist()
        parts_of = pieces(data)
        owner = np.array([p.owner for p in parts_of], np.int64)
        runs = []
        for i, j in chunks([len(p.text) for p in parts_of], CHUNK):
            for make in (grams, words):
                own, size = make(parts_of[i:j])
                distinct, inverse = np.unique(own, return_inverse=True)
                runs.append((i, j, size, distinct, inverse.astype(np.int32)))
        keys = np.unique(np.concatenate([r[3] for r in runs])) if runs else np.zeros(0, np.uint64)
        value = np.zeros(len(keys))
        part = part_of(keys, parts)
        for p, d in zip(right.column("part").to_pylist(), right.column("data").to_pylist(), strict=True):
            value[part == p] = np.frombuffer(d)
        n_tokens, known, base, score = (np.zeros(len(data)) for _ in range(4))
        seen, kind = total + ends, kinds.value + (ends > 0)
        scale = np.log10(seen + 0.1 * (kind + 1))
        for k, (i, j, size, distinct, inverse) in enumerate(runs):
            own = value[np.searchsorted(keys, distinct)]
            if k % 2 == 0:  # grams, then words of the same texts
                np.add.at(score, owner[i:j], np.add.reduceat(own[inverse], np.cumsum(size) - size))
                continue
            of = np.repeat(owner[i:j], size)
            np.add.at(n_tokens, owner[i:j], size)
            known += np.bincount(of, (own > 0)[inverse], len(data))
            base += np.bincount(of, np.log10(own + 0.1)[inverse], len(data))
        n_tokens += 1
        base += np.log10(ends + 0.1) - scale * n_tokens
        known += ends > 0
        n = np.full(len(data), seen, np.int64)
        return pa.table([left.column("doc_id"), left.column("held_out"), n_tokens.astype(np.int64), known.astype(np.int64), n, base, score], [c.split()[0] for c in COLUMNS.split(", ")])

    return run


def apart(spark: SparkSession, n: int) -> list[int]:
    """A number for each of n partitions that Spark's hash deals to it; one of its own where none is found."""
    tried = spark.range(24 * n + 64).select(F.col("id").cast("int").alias("k"))
    rows = tried.groupBy(F.pmod(F.hash("k"), F.lit(n)).alias("p")).agg(F.min("k").alias("k")).collect()  # at most MOST_TASKS
    found = {r.p: r.k for r in rows}
    return [found.get(p, 24 * n + 64 + p) for p in range(n)]


def score(docs: DataFrame, mod: int = 10, held: int = 0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``.

    Learned from the rows outside the fold crc32(doc_id) mod ``mod`` = ``held``. Null texts are empty and have their end as the only
    token; rows without a doc_id are scored, not learned from, and have held_out null; repeated rows each count and each give a row;
    very long texts are worked on in pieces; other columns are ignored; an empty table gives no rows. Without training texts every symbol costs the same.
    """
    spark = docs.sparkSession
    small_batches(spark)
    source = texts(docs).select("doc_id", F.col("text").cast("binary").alias("t"), (fold("doc_id", mod) == held).alias("held_out"))
    learn = F.coalesce(~F.col("held_out"), F.lit(False))
    counted = {r.k: r.n for r in source.select("t", learn.alias("learn")).mapInArrow(_low, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()}  # at most 65,536 x 257 contexts and symbols
    size, n_words = counted.pop(-1, 0), counted.pop(-2, 0)
    keys = np.array(sorted(counted), np.int64)
    low = (keys.astype(np.uint64), np.array([counted[k] for k in keys.tolist()], np.int64))
    ends = int(low[1][(low[0] & np.uint64(511)) == END].sum())
    blocks = max(1, -(-size // BLOCK_BYTES))
    parts = max(8, 2 * blocks)
    block = F.pmod(F.xxhash64("doc_id", "t"), F.lit(blocks)).cast("int")
    if blocks <= MOST_TASKS:  # a task for each
        block = F.get(F.from_json(F.lit(str(apart(spark, blocks))), "array<int>"), block)
    dealt = source.select(block.alias("block"), "doc_id", "t", "held_out").repartition(min(blocks, MOST_TASKS), "block")
    told = dealt.sortWithinPartitions("block").select("block", "doc_id", "t", learn.alias("learn")).mapInArrow(_tell(parts), "part int, block int, keys binary, counts binary")
    n = min(parts, MOST_TASKS)
    asked = told.repartitionById(n, F.col("part") % n).sortWithinPartitions("part")
    answers = written(asked.mapInArrow(_answer(spark.sparkContext.broadcast(low)), "part int, block int, data binary"))
    kinds = answers.where("block = -1").select("data").mapInArrow(_sum, "n double").agg(F.sum("n")).first()[0]
    shared = answers.where("block >= 0").repartition(min(blocks, MOST_TASKS), "block")
    return dealt.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(_score(parts, ends, n_words, spark.sparkContext.broadcast(int(kinds or 0))), COLUMNS)


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([float(np.frombuffer(b"".join(b.column(0).to_pylist())).sum())])], ["n"])
