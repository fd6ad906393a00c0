"""Benchmark decontamination by Wu-Manber search for many word sequences at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._io import dropped, may_occur, unclaimed, written
from ._words import ALNUM, Words, gather, shingles, sliced

WINDOW = 10
#: Slots of a shift table.
SLOTS = 1 << 18
#: Windows that one lane of the scan covers.
LANE = 512
#: Bytes of item texts that one pass over the documents searches for; more items take more passes.
MAX_ITEM_BYTES = 8_000_000
#: Tasks over which the rows of one text are dealt when they meet its occurrences.
PARTS = 16


def _same_bytes(a: Words, i: np.ndarray, b: Words, j: np.ndarray) -> np.ndarray:
    """Whether word i of ``a`` is word j of ``b``, byte by byte."""
    size = a.end[i] - a.start[i]
    same = size == b.end[j] - b.start[j]
    at = np.flatnonzero(same)
    near, far = gather(a.start[i[at]], size[at]), gather(b.start[j[at]], size[at])
    differ = a.buf[near] != b.buf[far]
    same[np.repeat(at, size[at])[differ]] = False
    return same


class WuManber:
    """Search tables for word sequences of one length m, all arrays: the words of the items, where sequences start in
    them, and the items that own each sequence.

    The shift table says for each block of two words how far the window may move: to the last place of that block in
    any sequence, or past it.  Where the shift is 0, the hash of the last and the first block selects a bucket of
    sequences, which are compared word by word: hashes first, then bytes.
    """

    def __init__(self, words: Words, start: np.ndarray, item: np.ndarray, m: int):
        self.m, self.words = m, words
        self.block = b = min(2, m)
        blocks = shingles(words.hash, b)
        # One entry for each distinct sequence, with all its items.
        whole = shingles(words.hash, m)[start]
        order = np.lexsort((item, whole))
        start, item, whole = start[order], item[order], whole[order]
        new = np.ones(len(start), bool)
        new[1:] = whole[1:] != whole[:-1]
        for j in range(m):
            new[1:] |= ~_same_bytes(words, start[1:] + j, words, start[:-1] + j)
        again = ~new
        again[1:] &= item[1:] == item[:-1]
        again[:1] = False
        self.owner, first = item[~again], np.flatnonzero(new[~again])
        start = start[new]
        self.owners_from, self.owners = first, np.diff(np.concatenate((first, [len(self.owner)])))
        self.shift = np.full(SLOTS, m - b + 1, np.int16)
        for j in range(m - b + 1):
            np.minimum.at(self.shift, self._slot(blocks[start + j]), m - b - j)
        key = self._key(blocks[start + m - b], blocks[start])
        order = np.argsort(key, kind="stable")
        self.key, self.start = key[order], start[order]
        self.owners_from, self.owners = self.owners_from[order], self.owners[order]

    @staticmethod
    def _slot(blocks: np.ndarray) -> np.ndarray:
        return (blocks & np.uint64(SLOTS - 1)).astype(np.int64)

    @staticmethod
    def _key(last: np.ndarray, first: np.ndarray) -> np.ndarray:
        return last * np.uint64(0x9E3779B97F4A7C15) ^ first

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(first word, sequence) of each occurrence inside one text."""
        m, b = self.m, self.block
        blocks = shingles(words.hash, b)
        windows = np.maximum(words.count - m + 1, 0)
        lanes = -(-windows // LANE)
        lane = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        first, end = np.repeat(words.first[:-1], lanes), np.repeat(words.first[:-1] + windows, lanes)
        at, stop = first + lane * LANE, np.minimum(first + (lane + 1) * LANE, end)
        slots, found = self._slot(blocks), []
        while len(at):
            step = self.shift[slots[at + m - b]]
            found.append(at[step == 0])
            at = at + np.maximum(step, 1).astype(np.int64)
            open_ = at < stop
            at, stop = at[open_], stop[open_]
        at = np.concatenate(found) if found else np.zeros(0, np.int64)
        key = self._key(blocks[at + m - b], blocks[at])
        low, high = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
        place = np.repeat(at, high - low)
        which = gather(low, high - low)
        for j in range(m):
            same = words.hash[place + j] == self.words.hash[self.start[which] + j]
            place, which = place[same], which[same]
        for j in range(m):
            same = _same_bytes(words, place + j, self.words, self.start[which] + j)
            place, which = place[same], which[same]
        return place, which

    def owned(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``which``, item) for every item of these sequences."""
        many = self.owners[which]
        return np.repeat(np.arange(len(which)), many), self.owner[gather(self.owners_from[which], many)]


def _searchers(texts: pa.Array, window: int) -> list[WuManber]:
    """One for each length: ``window``, and the lengths of shorter items."""
    words = Words(texts, ALNUM, lower=True)
    length = np.minimum(words.count, window)
    out = []
    for m in np.unique(length[length > 0]).tolist():
        own = np.flatnonzero(length == m)
        many = words.count[own] - m + 1
        out.append(WuManber(words, gather(words.first[own], many), np.repeat(own, many), m))
    return out


def _item_blocks(items: DataFrame, limit: int) -> list[DataFrame]:
    """Distinct items in blocks of at most ``limit`` bytes (or one longer item)."""
    at, k = F.xxhash64("item", "text"), 1
    while True:
        sizes = items.groupBy(F.pmod(at, F.lit(k)).alias("b")).agg(F.sum(F.octet_length("text")).alias("s"), F.count_distinct(at).alias("d")).collect()
        # Rows of one hash can't be parted further.
        if all(r["s"] <= limit or r["d"] == 1 for r in sizes):
            break
        k *= 2
    return [items.where(F.pmod(at, F.lit(k)) == b) for b in sorted(r["b"] for r in sizes)]


def _result(docs: DataFrame, keep: list[str], item: T.DataType) -> tuple[DataFrame, T.StructType]:
    """The columns ``keep`` with results that are empty yet, and the schema of that."""
    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("hits", spans), T.StructField("items", T.ArrayType(item))])
    none = F.lit(0).cast("long")
    return docs.select(*keep, none.alias("n_words"), none.alias("n_hit"), F.array().cast(spans).alias("hits"), F.array().cast(schema["items"].dataType).alias("items")), schema


def search_items(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, limit: int = MAX_ITEM_BYTES) -> DataFrame:
    """Adds to each row ``n_words``, ``hits`` (ranges of words inside occurrences: array of (start, end)), ``n_hit``
    (words in them) and ``items`` (identifiers of the items that occur, sorted as strings).

    An occurrence is one of ``window`` consecutive words of an item, or all words of a shorter one.  Null or empty
    texts have no words, hence no occurrence; items without words never occur; repeated rows and items all count, and
    an identifier with several texts has all of them; very long texts are searched whole; without documents or items
    there are no occurrences.  Input columns called like the new ones are replaced.

    A block of items, whose bytes are checked against ``limit``, is indexed as numpy arrays and sent to all tasks;
    driver and tasks hold one block at a time.  With one block nothing is shuffled.  More blocks take a pass over the
    texts each, which writes the occurrences of the texts that have some, never texts; these lists then meet the rows by
    the MD5 of the text.
    """
    spark = docs.sparkSession
    new = ["n_words", "n_hit", "hits", "items"]
    keep = [c for c in docs.columns if c not in new]
    listed = items.select(F.col(item).alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("text")).distinct()
    kind = listed.schema["item"].dataType
    out, schema = _result(docs, keep, kind)
    blocks = _item_blocks(listed, limit)

    def sent(block: DataFrame):
        rows = block.toArrow()
        return spark.sparkContext.broadcast((rows.column("item").to_pylist(), _searchers(rows.column("text").combine_chunks(), window)))

    nothing = spark.sparkContext.broadcast(([], []))
    if len(blocks) < 2:
        return _pass(out, text, keep, schema, sent(blocks[0]) if blocks else nothing)
    tid, may, part, more_hits, more_items = unclaimed([*keep, *new], "tid", "may", "part", "hits", "items")
    digest = F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    bare, bare_schema = _result(docs, [text], kind)
    lists = []
    for block in blocks:
        index = sent(block)
        met = _pass(bare, text, [text], bare_schema, index).where("n_hit > 0")
        lists.append(written(met.groupBy(digest.alias(tid)).agg(F.first("hits").alias("hits"), F.first("items").alias("items")), "hits"))
        index.destroy()
    every = reduce(DataFrame.unionByName, lists).groupBy(tid).agg(F.flatten(F.collect_list("hits")).alias(more_hits), F.flatten(F.collect_list("items")).alias(more_items))
    found = written(every, "found")
    dropped(*lists)
    # Texts that surely have no occurrence aren't shuffled; rows of one text are dealt over PARTS tasks.
    given = may_occur(out.withColumn(tid, digest), tid, found.select(tid), may)
    dealt = found.withColumn(part, F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    met = given.where(may).withColumn(part, F.spark_partition_id() % PARTS).join(dealt.hint("merge"), [tid, part], "left")
    met = met.select(*keep, "n_words", "n_hit", F.col(more_hits).alias("hits"), F.col(more_items).alias("items"))
    return _pass(met.unionByName(given.where(~F.col(may)).select(*met.columns)), text, keep, schema, nothing)


def _pass(docs: DataFrame, text: str, keep: list[str], schema: T.StructType, sent) -> DataFrame:
    """Adds the occurrences of one block of items to those found before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, searchers = sent.value
        for batch in sliced(batches, text):
            words = Words(batch.column(text), ALNUM, lower=True)
            edges = np.zeros(len(words.hash) + 1, np.int64)
            met = {d: set(old) for d, old in enumerate(batch.column("items").to_pylist()) if old}
            for d, spans in enumerate(batch.column("hits").to_pylist()):
                for s in spans or ():
                    edges[words.first[d] + s["start"]] += 1
                    edges[words.first[d] + s["end"]] -= 1
            for searcher in searchers:
                place, which = searcher.find(words)
                np.add.at(edges, place, 1)
                np.subtract.at(edges, place + searcher.m, 1)
                doc = np.searchsorted(words.first, place, "right") - 1
                pairs = np.unique(np.stack((doc, which), 1), axis=0)
                at, item = searcher.owned(pairs[:, 1])
                for d, i in zip(pairs[at, 0].tolist(), item.tolist(), strict=True):
                    met.setdefault(d, set()).add(names[i])
            hit = np.cumsum(edges[:-1]) > 0
            doc = np.repeat(np.arange(len(batch)), words.count)
            begin, end = hit.copy(), hit.copy()
            begin[1:] &= ~(hit[:-1] & (doc[1:] == doc[:-1]))
            end[:-1] &= ~(hit[1:] & (doc[1:] == doc[:-1]))
            b, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
            of = doc[b]
            spans = pa.StructArray.from_arrays([pa.array(b - words.first[of]), pa.array(e - words.first[of])], ["start", "end"])
            at = pa.array(np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(batch))))), pa.int32())
            found = [sorted(met.get(d, ()), key=str) for d in range(len(batch))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(words.count, pa.int64()), pa.array(np.bincount(doc[hit], minlength=len(batch)), pa.int64()), pa.ListArray.from_arrays(at, spans), pa.array(found, batch.schema.field("items").type)],
                schema.names,
            )

    return docs.mapInArrow(run, schema)
