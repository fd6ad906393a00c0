"""Substring de-duplication with a compressed FM-index per shard."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import dropped, may_occur, swept, unclaimed, written
from ._words import NOT_SPACE, Words, gather, list_array, mixed, numbered, shingles, sliced

WINDOW = 13
#: Words of the sequence whose smallest hash in a window is the window's anchor.
ANCHOR = 4
#: Documents that share an anchor, beyond which its windows are dealt out one by one.
HOT = 500
#: Symbols of a shard's index, on average.
SHARD_SYMBOLS = 150_000
#: Bytes of a passage for each word, about.
BYTES_A_SYMBOL = 6
#: Suffixes whose smallest owner is kept as one number.
BLOCK = 16


class WaveletTree:
    """Rank over a sequence of symbols, as a wavelet tree in the shape of their Huffman code.

    A symbol's path is its code, so the bit vectors together have as many bits as the code of the whole sequence (its
    entropy plus one bit a symbol at most), and frequent symbols are found in few steps.  Each level has one packed bit
    vector with a count before every 64 bits; inside it stand the nodes, in the order of the code's first bits.
    """

    def __init__(self, symbols: np.ndarray, alphabet: int):
        code, self.length = self._huffman(np.bincount(symbols, minlength=alphabet))
        self.bits, self.before, self.turn, self.start, self.base = [], [], [], [], []
        codes, lengths = code[symbols], self.length[symbols]
        for level in range(int(self.length.max())):
            ones = (codes >> (lengths - 1 - level) & 1).astype(bool)
            packed = np.packbits(np.concatenate((ones, np.zeros(64 - len(ones) % 64, bool))), bitorder="little").view(np.uint64)
            counts = np.bitwise_count(packed).astype(np.int32)
            self.bits.append(packed)
            self.before.append(np.cumsum(counts, dtype=np.int32) - counts)
            # Per symbol: which way it turns here, where its node starts, and the ones before that.
            deep = self.length > level
            left = np.where(deep, self.length - level, 0)
            start = np.searchsorted(codes >> (lengths - level), code >> left) * deep
            self.turn.append((code >> np.maximum(left - 1, 0) & 1).astype(bool))
            self.start.append(start.astype(np.int32))
            self.base.append(self._ones(level, start).astype(np.int32))
            more = lengths > level + 1
            codes, lengths = codes[more], lengths[more]
            order = np.argsort(codes >> (lengths - level - 1), kind="stable")
            codes, lengths = codes[order], lengths[order]

    @staticmethod
    def _huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code and its length for each symbol that occurs (at least one bit)."""
        heap = [(int(n), i) for i, n in enumerate(counts) if n]
        heapq.heapify(heap)
        parent, free = {}, len(counts)
        while len(heap) > 1:
            (m, a), (n, b) = heapq.heappop(heap), heapq.heappop(heap)
            parent[a] = parent[b] = free
            heapq.heappush(heap, (m + n, free))
            free += 1
        depth = np.zeros(free, np.int64)
        for node in range(free - 2, -1, -1):  # parents have larger numbers
            if node in parent:
                depth[node] = depth[parent[node]] + 1
        length = np.where(counts > 0, np.maximum(depth[: len(counts)], 1), 0)
        # Canonical codes: in the order of their lengths, each one more than the last.
        code, value, last = np.zeros(len(counts), np.int64), 0, 0
        for s in np.lexsort((np.arange(len(counts)), length)).tolist():
            if length[s]:
                value <<= int(length[s]) - last
                code[s], last = value, int(length[s])
                value += 1
        return code, length

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[level][word] + np.bitwise_count(self.bits[level][word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol, which must occur, is found before each place."""
        out, open_ = at.copy(), np.arange(len(at))
        for level in range(len(self.bits)):
            deep = self.length[symbol] > level
            if not deep.all():
                open_, symbol = open_[deep], symbol[deep]
            if not len(open_):
                break
            at = out[open_]
            ones = self._ones(level, self.start[level][symbol] + at) - self.base[level][symbol]
            out[open_] = np.where(self.turn[level][symbol], ones, at - ones)
        return out


class FmIndex:
    """Backward search over passages, whose words are symbols; a passage has an owner, the smallest document.

    Suffixes are sorted by their first ``reach`` symbols (doubling), which is all that patterns up to this length see.
    """

    def __init__(self, symbols: np.ndarray, sizes: np.ndarray, owners: np.ndarray, reach: int):
        n = len(symbols) + len(sizes)
        text = np.zeros(n, np.int64)  # 0 ends a passage
        ends = np.cumsum(sizes + 1) - 1
        inside = np.ones(n, bool)
        inside[ends] = False
        text[inside] = symbols + 1
        rank, width = text.copy(), 1
        while width < reach:
            key = rank * (n + 1) + np.concatenate((rank[width:], np.full(min(width, n), -1))) + 1 if width < n else rank * (n + 1)
            order = np.argsort(key, kind="stable")
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate(([0], np.diff(key[order]) > 0)))
            width *= 2
        order = np.argsort(rank, kind="stable")
        alphabet = int(text.max(initial=0)) + 1
        self.count = np.bincount(text, minlength=alphabet)
        self.smaller = np.concatenate(([0], np.cumsum(self.count)))
        self.n, self.wavelet = n, WaveletTree(text[order - 1], alphabet)
        # Smallest owner over any range of the suffix order: minima of blocks, then of powers of two of blocks.
        self.own = np.repeat(owners, sizes + 1)[order]
        padded = np.concatenate((self.own, np.full(-n % BLOCK, np.iinfo(np.int64).max)))
        self.minima = [padded.reshape(-1, BLOCK).min(1)]
        while 2 << (len(self.minima) - 1) <= len(self.minima[0]):
            half = 1 << (len(self.minima) - 1)
            self.minima.append(np.minimum(self.minima[-1][:-half], self.minima[-1][half:]))

    def matching_statistics(self, symbols: np.ndarray, first: np.ndarray, most: int, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a stream of documents: for each word, or each of ``ends``, the length of the longest match that ends there,
        ``most`` at most, and the suffix range [low, high) of its occurrences.

        ``symbols``: numbers of words, -1 for unknown ones; ``first``: the document's first place, for each word.  All
        places go backwards together, one symbol a step; a place leaves when its range would become empty.
        """
        ends = np.arange(len(symbols)) if ends is None else ends
        length = np.zeros(len(ends), np.int64)
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), self.n)
        alive = np.arange(len(ends))
        for step in range(most):
            alive = alive[ends[alive] - step >= first[ends[alive]]]
            code = symbols[ends[alive] - step] + 1
            known = (code > 0) & (code < len(self.count))
            known[known] = self.count[code[known]] > 0
            alive, code = alive[known], code[known]
            if not len(alive):
                break
            if step:
                both = self.smaller[np.concatenate((code, code))] + self.wavelet.rank(np.concatenate((code, code)), np.concatenate((low[alive], high[alive])))
                a, b = both[: len(alive)], both[len(alive) :]
            else:
                a, b = self.smaller[code], self.smaller[code + 1]
            met = a < b
            alive = alive[met]
            low[alive], high[alive], length[alive] = a[met], b[met], step + 1
        return length, low, high

    def smallest_owner(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Over ranges that aren't empty."""
        out = np.minimum(self.own[low], self.own[high - 1])
        for j in range(BLOCK):  # the ends of a range, up to whole blocks
            at = np.minimum(low + j, high - 1)
            out = np.minimum(out, np.where((low // BLOCK) == (at // BLOCK), self.own[at], out))
            at = np.maximum(high - 1 - j, low)
            out = np.minimum(out, np.where(((high - 1) // BLOCK) == (at // BLOCK), self.own[at], out))
        a, b = low // BLOCK + 1, (high - 1) // BLOCK
        wide = np.flatnonzero(b > a)
        level = np.frexp((b - a)[wide].astype(float))[1] - 1
        for k in np.unique(level):
            at = wide[level == k]
            out[at] = np.minimum(out[at], np.minimum(self.minima[k][a[at]], self.minima[k][b[at] - (1 << int(k))]))
        return out


def _anchors(words: Words, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per text: word hashes, and per window the place and the hash of its anchor."""
    none = np.zeros(0, np.int64)
    for a, n in zip(words.first.tolist(), words.count.tolist(), strict=False):
        own = words.hash[a : a + n]
        if n < window:
            yield own, none, none.view(np.uint64)
            continue
        grams = shingles(own, ANCHOR)
        place = np.arange(n - window + 1) + sliding_window_view(grams, window - ANCHOR + 1).argmin(1)
        yield own, place, grams[place]


def _signed(docs: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2):
            each = [np.unique(h) for _, _, h in _anchors(Words(batch.column(2), NOT_SPACE, lower=False), window)]
            flat = np.concatenate([*each, np.zeros(0, np.uint64)]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), list_array(flat, np.array([len(x) for x in each], np.int64), pa.int64())], ["doc", "tid", "uid", "anchors"])

    return docs.select("doc", "tid", "text", "uid").mapInArrow(run, "doc long, tid binary, uid long, anchors array<long>")


def _segments(held: DataFrame, window: int) -> DataFrame:
    """Passages around shared anchors: runs of windows with one anchor, or for hot anchors single windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            shared, hot = batch.column("anchors").to_pylist(), batch.column("hot").to_pylist()
            words = Words(batch.column("text"), NOT_SPACE, lower=False)
            row, route, start, size = [], [], [], []
            for i, (own, place, anchor) in enumerate(_anchors(words, window)):
                use = np.isin(anchor, np.array(shared[i], np.int64).view(np.uint64))
                single = np.isin(anchor, np.array(hot[i], np.int64).view(np.uint64))
                begin = use.copy()
                begin[1:] &= (place[1:] != place[:-1]) | ~use[:-1] | single[1:]
                starts = np.flatnonzero(begin)
                ends = np.flatnonzero(np.concatenate((use[:-1] & (begin[1:] | ~use[1:]), use[-1:])))
                route.append(np.where(single[starts], mixed(shingles(own, window)[starts]), anchor[starts]).astype(np.int64))
                row.append(np.full(len(starts), i))
                start.append(starts)
                size.append(ends - starts + window)
            none = np.zeros(0, np.int64)
            row, route, start, size = (np.concatenate([none, *x]) for x in (row, route, start, size))
            first = words.first[row] + start
            kept = gather(first, size)
            texts = _joined(words, kept, np.add.reduceat(np.concatenate((words.end[kept] - words.start[kept] + 1, [0])), np.cumsum(size) - size) if len(row) else none)
            of = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(route), batch.column("doc").take(of), batch.column("tid").take(of), pa.array(start, pa.int32()), texts], ["route", "doc", "tid", "start", "words"])

    return held.mapInArrow(run, "route long, doc long, tid binary, start int, words string")


def _first_owners(contents: DataFrame, window: int) -> DataFrame:
    """Per passage: for each of its windows, the smallest document of the shard that has it.

    The passages of a shard are indexed, and then pass through the index as documents: where a match of ``window`` words
    ends, its suffix range has all occurrences of the window.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        words = Words(pa.array(frame["words"], pa.string()), NOT_SPACE, lower=False, hashed=False)
        symbols, _ = numbered(words, NOT_SPACE)
        index = FmIndex(symbols, words.count, frame["doc"].to_numpy(), 2 * window)
        first, owners = np.repeat(words.first[:-1], words.count), np.zeros(len(symbols), np.int64)
        full = np.flatnonzero(np.arange(len(symbols)) - first >= window - 1)  # where a window can end
        for a in range(0, len(full), 100_000):
            ends = full[a : a + 100_000]
            length, low, high = index.matching_statistics(symbols, first, window, ends)
            above = length >= window
            owners[ends[above]] = index.smallest_owner(low[above], high[above])
        each = [owners[a + window - 1 : b] for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)]
        return pd.DataFrame({"shard": frame["shard"], "cid": frame["cid"], "owners": each})

    return contents.groupBy("shard").applyInPandas(run, "shard int, cid binary, owners array<long>")


def _merged(ranges: DataFrame) -> DataFrame:
    """Ranges of words, sorted and merged: flat array of start, end, start, end..."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for flat in batch.column("ranges").to_pylist():
                r = np.array(flat, np.int64).reshape(-1, 2)
                r = r[np.argsort(r[:, 0], kind="stable")]
                reach = np.maximum.accumulate(r[:, 1])
                new = np.concatenate(([True], r[1:, 0] > reach[:-1]))
                last = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(r) - 1]))
                out.append(np.stack((r[new, 0], reach[last]), 1).ravel().tolist())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("tid"), pa.array(out, pa.list_(pa.int32()))], ["doc", "tid", "ranges"])

    return ranges.mapInArrow(run, "doc long, tid binary, ranges array<int>")


def repeated_ranges(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc, tid, ranges, whole): where documents repeat ``window`` or more words of a document with a smaller key.

    ``tid`` is the MD5 of the text, ``ranges`` flat (start, end) word numbers, merged; ``whole``: the text equals one
    of a smaller key.  Documents that repeat nothing have no row.

    1. Equal texts: all but the one with the smallest key repeat it whole.
    2. A window's anchor is the smallest hash of the word sequences in it; equal windows have equal anchors.  Only
       anchors of two documents or more go on, each document with its own.  Hashes only choose what is compared.
    3. Passages around these anchors go, as text, to the shard of the anchor; windows of hot anchors to the shard of the
       window.  Equal passages are one, owned by the smallest key.  A shard's size doesn't depend on the number of
       documents.
    4. Each shard numbers the words of its passages and builds an FM-index; matching statistics by backward search give
       the occurrences of every window, and the smallest owner among them.

    All joins merge, so that there is one plan at every size.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("tid", F.unhex(F.md5(F.col("text").cast("binary")))).withColumn("uid", F.xxhash64("doc", "tid"))
    signed = written(_signed(rows, window), "anchors")
    firsts = written(signed.groupBy("tid").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last"), "firsts")
    later = signed.select("doc", "tid", "uid").distinct().join(firsts.hint("merge"), "tid").where("doc > first").select("doc", "tid", "uid")
    later = written(later, "later")
    told = may_occur(signed.select("doc", "tid", "uid", "anchors"), "uid", later.select("uid"), "_may")
    unique = told.where("NOT _may").unionByName(told.where("_may").join(later.hint("merge"), ["doc", "tid"], "left_anti")).select("doc", "uid", F.explode("anchors").alias("anchor"))
    shared = written(unique.groupBy("anchor").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo < hi").select("anchor", (F.col("m") > HOT).alias("is_hot")), "shared")
    own = unique.select("uid", "anchor").join(shared.hint("merge"), "anchor")
    by_doc = written(own.groupBy("uid").agg(F.collect_set("anchor").alias("anchors"), F.collect_set(F.when(F.col("is_hot"), F.col("anchor"))).alias("hot")), "own")
    dropped(signed, firsts, shared)
    swept(spark)
    held = may_occur(rows, "uid", by_doc.select("uid"), "_may").where("_may")
    segments = written(_segments(held.join(by_doc.hint("merge"), "uid").select("doc", "tid", "text", "anchors", "hot"), window), "segments")
    dropped(by_doc)
    swept(spark)
    windows = segments.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    shards = max(16, -(-windows // BYTES_A_SYMBOL // SHARD_SYMBOLS))
    placed = segments.withColumn("shard", F.pmod("route", F.lit(shards)).cast("int")).withColumn("cid", F.unhex(F.md5(F.col("words").cast("binary"))))
    contents = placed.groupBy("shard", "cid", "words").agg(F.min("doc").alias("doc"))
    owners = written(_first_owners(contents, window), "owners")
    swept(spark)
    flagged = placed.select("shard", "cid", "doc", "tid", "start").join(owners.hint("merge"), ["shard", "cid"])
    starts = F.filter(F.transform("owners", lambda o, i: F.when(o < F.col("doc"), i + F.col("start"))), lambda x: x.isNotNull())
    # The windows of a passage that are repeated stand next to each other but for rare gaps: first and last of each run.
    spans = flagged.withColumn("s", starts).where(F.size("s") > 0).withColumn(
        "s", F.when(F.element_at("s", -1) - F.col("s")[0] == F.size("s") - 1, F.array(F.col("s")[0], F.element_at("s", -1) + window)).otherwise(F.flatten(F.transform("s", lambda x: F.array(x, x + window))))
    )
    ranges = _merged(spans.groupBy("doc", "tid").agg(F.flatten(F.collect_list("s")).alias("ranges")))
    found = ranges.withColumn("whole", F.lit(False)).unionByName(later.select("doc", "tid").withColumns({"ranges": F.array().cast("array<int>"), "whole": F.lit(True)}))
    out = written(found.select("doc", "tid", "ranges", "whole"), "ranges")
    dropped(segments, owners, later)
    swept(spark)
    return out


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, kept: str = "kept_text") -> DataFrame:
    """Adds to each row ``n_words``, ``n_removed`` and ``kept``, the words that stay, joined by single spaces.

    A word goes if a window of ``window`` words covers it that also starts in a document with a smaller key; windows
    are judged on the input.  Words are ``[^\\x20\\x09-\\x0D]+``.  Null and empty texts have no words; texts shorter
    than a window stay; rows with one key don't remove each other's words; rows without a key stay whole; very long
    texts are judged whole; an empty table gives an empty one.  Input columns called like the new ones are replaced; all
    others stay, whatever their names.
    """
    found = repeated_ranges(docs, key, text, window)
    new = ["n_words", "n_removed", kept]
    tid = F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    keep = [c for c in docs.columns if c not in new]
    doc, mine, may, at, all_of = unclaimed([*docs.columns, *new], "doc", "tid", "may", "ranges", "whole")
    given = docs.select(*keep).withColumns({doc: F.col(key).cast("long"), mine: tid})
    told = found.withColumnsRenamed({"doc": doc, "tid": mine, "ranges": at, "whole": all_of})
    # Texts that surely keep all their words aren't shuffled.
    given = may_occur(given, doc, told.select(doc), may)
    met = given.where(F.col(may)).join(told.hint("merge"), [doc, mine], "left").select(*keep, at, all_of)
    joined = met.unionByName(given.where(~F.col(may)).select(*keep, F.lit(None).cast("array<int>").alias(at), F.lit(None).cast("boolean").alias(all_of)))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + f", n_words long, n_removed long, `{kept}` string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text):
            words = Words(batch.column(text), NOT_SPACE, lower=False, hashed=False)
            edges = np.zeros(len(words.start) + 1, np.int64)
            every, whole = batch.column(at).to_pylist(), batch.column(all_of).to_pylist()
            for i, (flat, all_) in enumerate(zip(every, whole, strict=True)):
                a = int(words.first[i])
                if all_ and words.count[i] >= window:
                    flat = [0, int(words.count[i])]
                if flat:
                    np.add.at(edges, a + np.array(flat[::2]), 1)
                    np.subtract.at(edges, a + np.array(flat[1::2]), 1)
            stays = np.cumsum(edges[:-1]) == 0
            doc = np.repeat(np.arange(len(batch)), words.count)
            # All kept words, each with the space after it, in one buffer; a text's last space is cut off.
            left = np.bincount(doc[stays], minlength=len(batch))
            size = np.where(stays, words.end - words.start + 1, 0)
            texts = _joined(words, np.flatnonzero(stays), np.bincount(doc, size, len(batch)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(words.count, pa.int64()), pa.array(words.count - left, pa.int64()), texts], [*keep, *new])

    return joined.mapInArrow(run, schema)


def _joined(words: Words, kept: np.ndarray, sizes: np.ndarray) -> pa.Array:
    start, size = words.start[kept], words.end[kept] - words.start[kept] + 1
    at = gather(start, size)
    buf = np.concatenate((words.buf, np.zeros(1, np.uint8)))[at]
    buf[np.cumsum(size) - 1] = 32
    ends = np.cumsum(sizes)
    cut = ends[sizes > 0] - 1
    buf = np.delete(buf, cut)
    offsets = np.concatenate(([0], np.cumsum(sizes - (sizes > 0))))
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(buf)).cast(pa.string())
