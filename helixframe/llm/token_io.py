"""Token ids as directly addressable codes: chunk levels, continuation bitmaps and rank directories."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._io import fresh_path
from ._words import NOT_SPACE, Words, gather, sliced

#: Bits of a chunk: one byte, so that a chunk is read without shifts.
CHUNK_BITS = 8
#: Bits of a bitmap that one entry of the rank directory covers.
RANK_BITS = 512
MAGIC = b"DAC1"


class DirectCodes:
    """Levels of byte chunks of unsigned 32-bit values.

    Level 0 has the low byte of every value and a bitmap of those that go on; level k + 1 has the next byte of these.
    The place of a value in level k + 1 is the rank of its bit in level k's bitmap: a directory entry, a count over at
    most ``RANK_BITS`` bits.  So any value is read without decoding its neighbours.
    """

    def __init__(self, levels: list[np.ndarray], bitmaps: list[np.ndarray], ranks: list[np.ndarray]):
        self.levels, self.bitmaps, self.ranks = levels, bitmaps, ranks

    @classmethod
    def encode(cls, values: np.ndarray) -> DirectCodes:
        values = values.astype(np.uint32)
        levels, bitmaps, ranks = [], [], []
        while True:
            levels.append((values & np.uint32(0xFF)).astype(np.uint8))
            values = values >> np.uint32(CHUNK_BITS)
            more = values > 0
            packed = np.packbits(np.concatenate((more, np.zeros(-len(more) % RANK_BITS, bool))), bitorder="little")
            each = np.bitwise_count(packed.view(np.uint64)).reshape(-1, RANK_BITS // 64).sum(1)
            bitmaps.append(packed)
            ranks.append((np.cumsum(each) - each).astype(np.uint32))
            if not more.any():
                return cls(levels, bitmaps, ranks)
            values = values[more]

    def __len__(self) -> int:
        return len(self.levels[0])

    def get(self, i: int) -> int:
        """Value i alone."""
        out, k = 0, 0
        while True:
            out |= int(self.levels[k][i]) << (CHUNK_BITS * k)
            word, bit = i // 64, i % 64
            map64 = self.bitmaps[k].view(np.uint64)
            if not int(map64[word]) >> bit & 1:
                return out
            first = i // RANK_BITS * (RANK_BITS // 64)
            i = int(self.ranks[k][i // RANK_BITS]) + int(np.bitwise_count(map64[first:word]).sum()) + (int(map64[word]) & ((1 << bit) - 1)).bit_count()
            k += 1

    def decode(self) -> np.ndarray:
        """All values."""
        out = self.levels[-1].astype(np.uint32)
        for chunk, bits in zip(self.levels[-2::-1], self.bitmaps[-2::-1], strict=True):
            more = np.unpackbits(bits, count=len(chunk), bitorder="little").astype(bool)
            high, out = out, chunk.astype(np.uint32)
            out[more] |= high << np.uint32(CHUNK_BITS)
        return out

    def to_bytes(self) -> bytes:
        parts = [MAGIC, np.array([len(self.levels)], "<u4").tobytes()]
        for chunk, bits, rank in zip(self.levels, self.bitmaps, self.ranks, strict=True):
            parts += [np.array([len(chunk)], "<u8").tobytes(), rank.astype("<u4").tobytes(), bits.tobytes(), chunk.tobytes()]
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, raw: bytes) -> DirectCodes:
        if raw[:4] != MAGIC:
            raise ValueError("not a block of directly addressable codes")
        n, at = int(np.frombuffer(raw, "<u4", 1, 4)[0]), 8
        levels, bitmaps, ranks = [], [], []
        for _ in range(n):
            size = int(np.frombuffer(raw, "<u8", 1, at)[0])
            blocks = -(-size // RANK_BITS)
            ranks.append(np.frombuffer(raw, "<u4", blocks, at := at + 8))
            bitmaps.append(np.frombuffer(raw, np.uint8, blocks * RANK_BITS // 8, at := at + 4 * blocks).copy())
            levels.append(np.frombuffer(raw, np.uint8, size, at := at + blocks * RANK_BITS // 8))
            at += size
        return cls(levels, bitmaps, ranks)


#: Bytes of words that are cut where letters, digits and marks meet: printable ASCII but for the apostrophe, which starts
#: endings like 's, and "<", which starts special tokens.
_LETTER, _DIGIT, _MARK, _OTHER = range(4)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[0x21:0x7F] = _MARK
_CLASS[[0x27, 0x3C]] = _OTHER
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = _LETTER


class WordCoder:
    """Ids of whole texts from a tokenizer that lower-cases, drops white space and codes runs of letters, single digits
    and runs of marks one by one.

    Numpy cuts an Arrow column into such units; words with other bytes stay whole, for the tokenizer to cut.  Arrow
    numbers the units of a batch, so each distinct one enters Python once, and the tokenizer only if it is new.
    ``limit`` bounds the units kept; beyond it the cache starts afresh.
    """

    def __init__(self, path: str, limit: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core already
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.last[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.seen, self.ids, self.ends = {}, np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of ids of each; null texts have none."""
        words = Words(column, NOT_SPACE, lower=False, hashed=False)
        if not len(words.start):
            return np.zeros(0, np.int32), np.zeros(len(column), np.int64)
        raw = words.buf[NOT_SPACE[words.buf]]
        size = words.end - words.start
        at = np.cumsum(size) - size
        kind = _CLASS[raw]
        cut = np.repeat(np.maximum.reduceat(kind, at) < _OTHER, size)
        begins = np.empty(len(raw), bool)
        begins[0] = True
        np.not_equal(kind[1:], kind[:-1], out=begins[1:])
        begins |= kind == _DIGIT
        begins &= cut
        begins[at] = True
        raw = np.where(cut & (kind == _LETTER), raw | np.uint8(0x20), raw)
        start = np.flatnonzero(begins)
        units = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(np.concatenate((start, [len(raw)]))), pa.py_buffer(raw)).dictionary_encode()
        place = self._places(units.dictionary.to_pylist())[units.indices.to_numpy(zero_copy_only=False)]
        begin, many = self.ends[place], self.ends[place + 1] - self.ends[place]
        first = np.searchsorted(start, np.concatenate((at, [len(raw)]))[words.first])
        total = np.concatenate(([0], np.cumsum(many)))
        return self.ids[gather(begin, many)], np.diff(total[first])

    def _places(self, units: list[str]) -> np.ndarray:
        if len(self.seen) > self.limit:
            self._clear()
        new = [u for u in units if u not in self.seen]
        if new:
            # A unit's last token, and no other, ends with the mark of word ends: many units can be one text.
            plain, odd = [], []
            for u in new:
                (plain if u.isascii() and u.isprintable() and "'" not in u and "<" not in u else odd).append(u)
            texts = [" ".join(plain[i : i + 1000]) for i in range(0, len(plain), 1000)]
            ids = np.fromiter(chain.from_iterable(x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)), np.int32)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(plain):
                raise ValueError("the tokenizer cuts words in another way")
            each = [x.ids for x in self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)]
            more = len(ids) + np.cumsum(np.fromiter(map(len, each), np.int64, len(each)))
            self.seen.update(zip([*plain, *odd], range(len(self.seen), len(self.seen) + len(new)), strict=True))
            self.ends = np.concatenate((self.ends, len(self.ids) + np.concatenate((ends, more))))
            self.ids = np.concatenate((self.ids, ids, np.fromiter(chain.from_iterable(each), np.int32)))
        return np.fromiter(map(self.seen.__getitem__, units), np.int64, len(units))


@lru_cache(2)
def _coder(path: str) -> WordCoder:
    """Kept as long as the Python worker lives, over tasks."""
    return WordCoder(path)


#: The written table: one row is a block of whole documents of a partition.
BLOCKS = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("start", T.LongType()),
    T.StructField("n_tokens", T.LongType()), T.StructField("doc_ids", T.ArrayType(T.LongType())),
    T.StructField("doc_tokens", T.ArrayType(T.LongType())), T.StructField("codes", T.BinaryType()),
])


def write_tokens(df: DataFrame, path: str, tokenizer_path: str, end_id: int | None = 1, key: str = "doc_id", text: str = "text", block_chars: int = 4_000_000) -> None:
    """Encodes all texts and writes their ids as blocks of directly addressable codes, in ascending order of ``key``.

    The tokenizer must be of the kind that ``WordCoder`` describes.  Null and empty texts have only the end id.  Rows are
    dealt out by ranges of the key and a hash of the text, so partition p holds smaller keys than p + 1 and a repeated
    key is no group; rows with the same key come in the order of that hash, repeated rows all stay, rows without a key
    come first.  An empty table gives an empty one; other columns aren't read.  The files are a Parquet table (columns
    ``BLOCKS``): ``codes`` is the code of the ids of a block of whole documents of about ``block_chars`` bytes at most (or
    one longer document), ``start`` the ids of the partition before the block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, start = TaskContext.get().partitionId(), 0, 0
        coder = _coder(tokenizer_path)
        for rows in sliced(batches, 1, block_chars):
            flat, size = coder.encode(rows.column(1))
            if end_id is not None:
                flat, size = np.insert(flat, np.cumsum(size), end_id), size + 1
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            columns = [pa.array([x]) for x in (part, block, start, len(flat))] + [one(rows.column(0)), one(pa.array(size, pa.int64())), pa.array([DirectCodes.encode(flat).to_bytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)
            block, start = block + 1, start + len(flat)

    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    tie = F.xxhash64("text")
    rows.repartitionByRange("key", tie).sortWithinPartitions("key", tie, "text").mapInArrow(run, BLOCKS).write.parquet(path)


_ARROW = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("codes", pa.binary())])


def read_blocks(spark, path: str) -> DataFrame:
    """The blocks with ``first``: the number of ids in all blocks before.

    Only the totals of the partitions pass through the driver, one number each.
    """
    blocks = spark.read.schema(BLOCKS).parquet(path)
    totals = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    before, total = [], 0
    for r in totals:
        before.append((r["part"], total))
        total += r["n"]
    offsets = spark.createDataFrame(before, "part int, before long")
    return blocks.join(F.broadcast(offsets), "part").withColumn("first", F.col("before") + F.col("start")).drop("before")


def read_tokens(spark, path: str, fields: str = "ids array<int>", of=lambda ids: {"ids": ids.astype(np.int32)}) -> DataFrame:
    """A row per document from the files: its key, ``start`` (ids before it), ``n_tokens`` and what ``of`` makes of its
    ids (a numpy array of unsigned 32-bit integers)."""
    schema = f"doc_id long, start long, n_tokens long, {fields}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                keys, sizes, codes, first = (batch.column(c)[i] for c in ("doc_ids", "doc_tokens", "codes", "first"))
                ids = DirectCodes.from_bytes(codes.as_buffer().to_pybytes()).decode()
                size = sizes.values.to_numpy()
                to = np.cumsum(size)
                more = [of(ids[a:b]) for a, b in zip((to - size).tolist(), to.tolist(), strict=True)]
                columns = {"doc_id": keys.values, "start": pa.array(first.as_py() + to - size), "n_tokens": sizes.values}
                columns |= {k: pa.array([m[k] for m in more]) for k in more[0]}
                yield pa.RecordBatch.from_pydict(columns)

    return read_blocks(spark, path).select("doc_ids", "doc_tokens", "codes", "first").mapInArrow(run, schema)


def token_at(spark, path: str, position: int) -> int | None:
    """One id by its position in the whole corpus: reads one block, and one value of it."""
    found = read_blocks(spark, path).where((F.col("first") <= position) & (F.col("first") + F.col("n_tokens") > position)).select("first", "codes").take(1)
    return DirectCodes.from_bytes(bytes(found[0]["codes"])).get(position - found[0]["first"]) if found else None


def token_path(spark) -> str:
    return fresh_path(spark, "tokens")


def crc32_of(ids: np.ndarray) -> dict[str, int]:
    return {"ids_crc32": zlib.crc32(ids.astype("<u4").tobytes())}
