"""Token-ID files: Parquet with one list of token ids a document, in ascending doc_id order.

Ids are written without a dictionary by the version 2 writer, so that they are delta-binary-packed; shard and lengths are
dictionary or delta columns beside them. Row groups and pages are of a set size, and the writer adds column and offset indexes,
so a reader of a few documents or of the metadata alone skips the other pages.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm.common import kept, shared_dir, small_batches, texts, trim
from sextant.llm.shingles import chunks, span_hashes

#: Of one file: about so many documents. A shard of sorted rows is a task and as a rule one file; beyond SHARDS shards of that size,
#: shards hold more, sorted and written as a stream, in several files.
DOCS_PER_FILE, SHARDS = 8192, 100_000
#: Chunks that a worker remembers before it forgets them all: bounds its memory.
CACHE = 1_000_000
OTHER, SPACE, BREAK, LETTER, STOP = range(5)
BYTE_KIND = np.zeros(256, np.uint8)
BYTE_KIND[32] = SPACE
BYTE_KIND[[9, 10, 11, 12, 13]] = BREAK
BYTE_KIND[[*range(65, 91), *range(97, 123)]] = LETTER
BYTE_KIND[[*range(33, 39), *range(40, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = STOP  # no apostrophe: it may begin a contraction
CASED = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)

WRITER = {
    "compression": "zstd",
    "parquet.compression.codec.zstd.level": "1",
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#shard": "true",
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(128 << 10),
    "parquet.page.row.count.limit": "1000",
    "parquet.columnindex.truncate.length": "64",
}

SCHEMA = "shard int, doc_id long, local_start long, n_tokens long, tokens array<int>"


class Encoder:
    """Ids of texts, the same as the library's for the whole text, with every distinct chunk of text encoded once.

    The vocabulary's pre-tokenizer never joins across a single blank (a space goes with what follows it) nor from a letter to a
    mark (other than an apostrophe), so texts are cut there. Chunks are told apart by 64-bit hashes in numpy. Texts in which white space stands
    beside white space, or that hold white space beyond ASCII or the content of an added token, are encoded whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # every chunk comes once, so the library's own cache is of no use
        self._forget()

    def _forget(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # sorted hashes, and where each one's ids are
        self.begin, self.count, self.ids = np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32), np.zeros(1 << 17, np.int32)
        self.n_chunks = self.n_ids = 0

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.zeros(max(n, len(a) * 3 // 2) - len(a), a.dtype)])

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _with_added(self, raw: bytes, bounds: np.ndarray) -> np.ndarray:
        """Texts that hold an added token's content; one across two texts doesn't count."""
        found = []
        for content in self.added:
            at = raw.find(content)
            while at >= 0:
                i = int(np.searchsorted(bounds, at, side="right")) - 1
                inside = at + len(content) <= bounds[i + 1]
                if inside:
                    found.append(i)
                at = raw.find(content, int(bounds[i + 1]) if inside else at + 1)
        return np.array(found, np.int64)

    def _rows(self, hashed: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Row of the table of chunks for each distinct hash; chunks that aren't there yet are encoded."""
        rows = np.full(len(hashed), -1, np.int32)
        for known, at in self.levels:
            place = np.minimum(np.searchsorted(known, hashed), len(known) - 1)
            hit = known[place] == hashed
            rows[hit] = at[place[hit]]
        new = np.flatnonzero(rows < 0)
        if len(new):
            flat, count = array("i"), np.empty(len(new), np.int32)
            for i in range(0, len(new), 4096):  # few of the library's objects at a time
                part = new[i : i + 4096]
                # As words of one sequence: the library treats each by itself and makes a single object for all.
                got = self.tokenizer.encode([raw[s:e].decode() for s, e in zip(starts[part].tolist(), ends[part].tolist(), strict=True)], is_pretokenized=True, add_special_tokens=False)
                flat.extend(got.ids)
                count[i : i + len(part)] = np.bincount(np.array(got.word_ids, np.int64), minlength=len(part))
            n, m = self.n_chunks, self.n_ids
            at = (n + np.arange(len(new))).astype(np.int32)
            self.n_chunks, self.n_ids = n + len(new), m + len(flat)
            self.begin, self.count, self.ids = (self._room(x, k) for x, k in ((self.begin, self.n_chunks), (self.count, self.n_chunks), (self.ids, self.n_ids)))
            self.begin[n : self.n_chunks] = m + np.cumsum(count) - count
            self.count[n : self.n_chunks] = count
            self.ids[m : self.n_ids] = np.frombuffer(flat, np.int32)
            rows[new] = at
            own = (hashed[new], at)
            while self.levels and len(self.levels[-1][0]) <= 4 * len(own[0]):
                last = self.levels.pop()
                both = np.concatenate([last[0], own[0]])
                order = np.argsort(both, kind="stable")
                own = (both[order], np.concatenate([last[1], own[1]])[order])
            self.levels.append(own)
        return rows

    def encode(self, raw: np.ndarray, bounds: np.ndarray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has; ``end_id`` closes each text. Texts are the bytes of ``raw`` between ``bounds``."""
        if self.n_chunks > CACHE:
            self._forget()
        n = len(bounds) - 1
        total, flat, hard = np.zeros(n, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)
        if len(raw):
            data = raw.tobytes()
            kind = BYTE_KIND[raw]
            blank = (kind == SPACE) | (kind == BREAK)
            pair = blank[1:] & blank[:-1] | (raw[:-1] == 0xC2) & ((raw[1:] == 0x85) | (raw[1:] == 0xA0)) | (raw[:-1] == 0xE1) & (raw[1:] == 0x9A)
            pair |= (raw[:-1] == 0xE2) & (raw[1:] <= 0x81) & (raw[1:] >= 0x80) | (raw[:-1] == 0xE3) & (raw[1:] == 0x80)
            hard = np.union1d(np.searchsorted(bounds, np.flatnonzero(pair), side="right") - 1, self._with_added(data, bounds))  # a pair across two texts does no harm
            cut = np.zeros(len(raw) + 1, bool)
            cut[:-1] = blank
            letter = kind[:-1] == LETTER
            letter[1:] |= (raw[:-2] == 0xC3) & (raw[1:-1] >= 0x80) & (raw[1:-1] != 0x97) & (raw[1:-1] != 0xB7)  # of Latin-1, but for the two signs
            cut[1:-1] |= (kind[:-1] == BREAK) | ((kind[1:] == STOP) & letter)
            cut[bounds] = True
            edge = np.flatnonzero(cut)
            starts, ends = edge[:-1], edge[1:]
            of = np.searchsorted(bounds, starts, side="right") - 1
            if len(hard):
                easy = ~np.isin(of, hard)
                starts, ends, of = starts[easy], ends[easy], of[easy]
            distinct, first, inverse = np.unique(span_hashes(raw, starts, ends, CASED), return_index=True, return_inverse=True)
            rows = self._rows(distinct, data, starts[first], ends[first])[inverse]
            count = self.count[rows].astype(np.int64)
            before = np.cumsum(count) - count
            flat = self.ids[np.repeat(self.begin[rows].astype(np.int64) - before, count) + np.arange(int(count.sum()))]
            total = np.bincount(of, count, n).astype(np.int64)
        if not len(hard) and end_id is None:
            return flat, total
        ends = np.cumsum(total)
        if len(hard):
            whole = self.plain([raw[bounds[i] : bounds[i + 1]].tobytes().decode() for i in hard.tolist()])
            flat = np.insert(flat, np.repeat(ends[hard], [len(x) for x in whole]), np.concatenate(whole))
            total[hard] = [len(x) for x in whole]
            ends = np.cumsum(total)
        if end_id is not None:
            flat, total = np.insert(flat, ends, end_id), total + 1
        return flat, total

    def encode_texts(self, texts: list[str], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        data = [t.encode() for t in texts]
        return self.encode(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]), end_id)


def _encode(path: str, end_id: int, cuts, packed: str) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept(f"tokens {path}", lambda: Encoder(path))
        bounds = np.array(cuts.value, np.int64)
        for b in batches:
            ids, text = b.column(0), b.column(1)
            at = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
            raw = np.frombuffer(text.buffers()[2] or b"", np.uint8)
            for i, j in chunks(np.diff(at).tolist(), 1 << 20):
                flat, count = own.encode(raw[at[i] : at[j]], at[i : j + 1] - at[i], end_id)
                part = ids.slice(i, j - i)
                shard = np.searchsorted(bounds, part.fill_null(-(1 << 62)).to_numpy(zero_copy_only=False), side="right").astype(np.int32)
                data = flat.astype(packed)
                offsets = np.concatenate([[0], np.cumsum(count)]) * data.itemsize
                binary = pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([pa.array(shard), part, binary], ["shard", "doc_id", "ids"])

    return run


def _number(packed: str) -> object:
    """Rows of one shard after the other, sorted: ids of the shard before each document, and the ids as a list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, before = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            data = b.column(2)
            at = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1]
            flat = np.frombuffer((data.buffers()[2] or b"")[at[0] : at[-1]], packed)
            counts = np.diff(at).astype(np.int64) // flat.itemsize
            start = np.empty(len(counts), np.int64)
            for i, (s, n) in enumerate(zip(b.column(0).to_pylist(), counts.tolist(), strict=True)):
                before = before if s == shard else 0
                shard, start[i] = s, before
                before += n
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(start), pa.array(counts), lists], ["shard", "doc_id", "local_start", "n_tokens", "tokens"])

    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, docs_per_file: int = DOCS_PER_FILE) -> None:
    """Encode every text (null: empty), append ``end_id``, write files of about ``docs_per_file`` documents in doc_id order.

    Only ids are read to find the files' bounds (approximate quantiles: any bounds give the same order). Rows of one doc_id stay
    together, by their ids; null ids come first; very long texts are one list each. Other columns are ignored; an empty table gives a file without rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    own = texts(docs)
    n, = own.agg(F.count("doc_id")).first()
    files = max(1, min(-(-n // docs_per_file), SHARDS))
    cuts = sorted(set(own.agg(F.percentile_approx("doc_id", [k / files for k in range(1, files)], 20 * files)).first()[0])) if files > 1 else []
    held = spark.sparkContext.broadcast(cuts)  # a number for each file
    packed = "<u2" if vocabulary_size(vocabulary) <= 1 << 16 else "<u4"
    coded = own.select("doc_id", F.col("text").cast("binary")).mapInArrow(_encode(vocabulary, end_id, held, packed), "shard int, doc_id long, ids binary")
    dealt = coded.repartitionById(len(cuts) + 1, F.col("shard")).sortWithinPartitions("shard", "doc_id", "ids")
    dealt.mapInArrow(_number(packed), SCHEMA).write.options(**WRITER).option("maxRecordsPerFile", 2 * docs_per_file).parquet(path)


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    size = Tokenizer.from_file(path).get_vocab_size()
    trim()  # the driver has no more use for the tokenizer
    return size


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """shard, doc_id, local_start, n_tokens, tokens and ``start``: ids of all documents before this one, in file order."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    sums = {r.shard: r.n for r in rows.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()}  # a row for each file
    starts, before = [], 0
    for k in sorted(sums):
        starts.append((k, before))
        before += sums[k]
    base = spark.createDataFrame(starts, "shard int, base long")
    return rows.join(F.broadcast(base), "shard").withColumn("start", F.col("base") + F.col("local_start")).drop("base")


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """shard, doc_id, local_start, n_tokens of every document: the pages of ids are not read."""
    return spark.read.schema(SCHEMA).parquet(path).select("shard", "doc_id", "local_start", "n_tokens")


def tokens_between(spark: SparkSession, path: str, low: int, high: int) -> DataFrame:
    """doc_id and ids of the documents from id ``low`` to ``high``: files, row groups and pages whose ids lie elsewhere are passed over."""
    return spark.read.schema(SCHEMA).parquet(path).where(F.col("doc_id").between(low, high)).select("doc_id", "tokens")


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column(3)
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes()
        at = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]) * 4
        view = memoryview(flat)
        sums = [zlib.crc32(view[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def digest(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of what ``read_tokens`` gives."""
    return rows.select("doc_id", "start", "n_tokens", "tokens").mapInArrow(_crc, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_and_read(docs: DataFrame, vocabulary: str) -> DataFrame:
    spark = docs.sparkSession
    path = shared_dir(spark)
    write_tokens(docs, path, vocabulary)
    return digest(read_tokens(spark, path))
