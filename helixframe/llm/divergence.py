"""Which terms and sources of a language differ: iceberg prefix refinement finds the terms, exact integers compare them."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._io import dropped, written
from ._words import Words, byte_class, numbered, sliced

#: ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+``, after lower-casing A-Z
LETTERS = byte_class([*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
#: Bytes of the prefixes of each level; complete terms follow.
LEVELS = (2, 4, 6, 8)
#: Bits of the map of kept prefixes that tasks get: 16 for each prefix, within these bounds.
FEWEST_BITS, MOST_BITS = 1 << 16, 1 << 26
#: Cells of the work matrices of a task.
CELLS = 1 << 20
#: Blocks (of 1 MB of text each) that a task decodes at once, and pairs of document and term that it joins.
GROUP_ROWS, PAIRS = 16, 1 << 21

_BLOCK = "lang string, sources array<string>, source array<int>, sizes array<int>, terms array<binary>, term array<int>, n array<int>"


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else [], kind))


def term_blocks(docs: DataFrame) -> DataFrame:
    """A row per language and run of texts of 1 MB: the distinct terms in order of their bytes, and for each document its
    source and the terms that it holds, with how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            langs = batch.column("lang").dictionary_encode()
            out: list[list] = [[] for _ in range(7)]
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                own = batch.filter(pc.equal(langs.indices, i))
                words = Words(own.column("text"), LETTERS, lower=True, hashed=False)
                ids, terms = numbered(words, LETTERS)
                order = pc.array_sort_indices(terms).to_numpy()
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                width = max(len(order), 1)
                held, n = np.unique(np.repeat(np.arange(len(words.count)), words.count) * width + rank[ids], return_counts=True)
                sources = own.column("source").dictionary_encode()
                row = (sources.dictionary, sources.indices.to_numpy(), np.bincount(held // width, minlength=own.num_rows), terms.take(pa.array(order)).cast(pa.binary()), held % width, n)
                for column, value in zip(out, (lang, *row), strict=True):
                    column.append(value)
            of_strings = lambda rows, kind: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)), pa.concat_arrays(rows) if rows else pa.array([], kind))
            ints = [_lists(out[k], pa.int32()) for k in (2, 3, 5, 6)]
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), of_strings(out[1], pa.string()), ints[0], ints[1], of_strings(out[4], pa.binary()), ints[2], ints[3]], ["lang", "sources", "source", "sizes", "terms", "term", "n"])

    told = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return told.mapInArrow(run, _BLOCK)


class _Held:
    """The blocks of one language in an Arrow batch, joined: ``doc``, ``term`` and ``n`` of each pair, ``terms``, and the
    source of each document."""

    def __init__(self, rows: pa.RecordBatch):
        flat = lambda c: rows.column(c).flatten()
        numbers = lambda c: flat(c).to_numpy(zero_copy_only=False).astype(np.int64)
        shifted = lambda values, lengths, by: values + np.repeat(np.cumsum(by) - by, lengths)
        lengths = lambda c: pc.list_value_length(rows.column(c)).to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = numbers("sizes")
        self.doc, self.n, self.terms = np.repeat(np.arange(len(sizes)), sizes), numbers("n"), flat("terms")
        self.term = shifted(numbers("term"), lengths("term"), lengths("terms"))
        names = flat("sources").dictionary_encode()
        self.sources = names.dictionary
        self.source = names.indices.to_numpy(zero_copy_only=False)[shifted(numbers("source"), lengths("source"), lengths("sources"))]

    def keep(self, terms: np.ndarray) -> None:
        stay = terms[self.term]
        self.doc, self.term, self.n = self.doc[stay], self.term[stay], self.n[stay]


def _by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.RecordBatch]]:
    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        for i, lang in enumerate(langs.dictionary.to_pylist()):
            yield lang, batch.filter(pc.equal(langs.indices, i))


def _held(batches: Iterator[pa.RecordBatch], pairs: int = PAIRS) -> Iterator[tuple[str, _Held]]:
    """The blocks of each language, joined while they have ``pairs`` pairs at most (or one longer block)."""
    for lang, rows in _by_lang(batches):
        ends, at = np.cumsum(pc.list_value_length(rows.column("term")).to_numpy(zero_copy_only=False), dtype=np.int64), 0
        while at < rows.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + pairs, "right")))
            yield lang, _Held(rows.slice(at, to - at))
            at = to


def _prefixes(terms: pa.Array, size: int | None) -> pa.DictionaryArray:
    return (terms if size is None else pc.binary_slice(terms, 0, size)).dictionary_encode()


class PrefixMap:
    """A bit map of (lang, prefix) pairs: no kept pair is missing; its size is bounded, so others may seem kept."""

    def __init__(self, kept: DataFrame, size: int | None):
        spark = kept.sparkSession
        self.size, self.bits = size, min(max(FEWEST_BITS, 1 << (16 * kept.count()).bit_length()), MOST_BITS)
        at = F.crc32(F.concat(F.col("lang").cast("binary"), F.lit(bytearray(1)), F.col("prefix"))) % self.bits
        bit = F.expr("shiftleft(1L, CAST(_at % 64 AS INT))")
        words = kept.select(at.alias("_at")).groupBy(F.expr("_at div 64").alias("w")).agg(F.bit_or(bit).alias("b")).toArrow()  # bits / 64 rows at most
        out = np.zeros(self.bits // 64, np.int64)
        out[words["w"].to_numpy()] = words["b"].to_numpy()
        self.sent = spark.sparkContext.broadcast(out.tobytes())

    def may_hold(self, lang: str, terms: pa.Array) -> np.ndarray:
        told, raw, head, mask = _prefixes(terms, self.size), self.sent.value, zlib.crc32(lang.encode() + b"\0"), self.bits - 1
        at = (zlib.crc32(p, head) & mask for p in told.dictionary.to_pylist())
        flags = np.fromiter((raw[i >> 3] >> (i & 7) & 1 for i in at), bool, len(told.dictionary))
        return flags[told.indices.to_numpy(zero_copy_only=False)]


def _documents(blocks: DataFrame, size: int | None, parents: PrefixMap | None) -> DataFrame:
    """(lang, prefix, docs): in how many documents the prefixes of ``size`` bytes (None: complete terms) occur whose
    prefixes of the level before may be kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, held in _held(batches):
            if parents:
                held.keep(parents.may_hold(lang, held.terms))
            told = _prefixes(held.terms, size)
            at = told.indices.to_numpy(zero_copy_only=False)[held.term]
            # A document's terms are in order, so those that share a prefix are neighbours.
            new = np.ones(len(at), bool)
            new[1:] = (at[1:] != at[:-1]) | (held.doc[1:] != held.doc[:-1])
            docs = np.bincount(at[new], minlength=len(told.dictionary))
            met = np.flatnonzero(docs)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(met), pa.string()), told.dictionary.take(pa.array(met)), pa.array(docs[met], pa.int64())], ["lang", "prefix", "docs"])

    needed = blocks.select("lang", "sources", "source", "sizes", "terms", "term", "n")
    return needed.mapInArrow(run, "lang string, prefix binary, docs long").groupBy("lang", "prefix").agg(F.sum("docs").alias("docs"))


def kept_terms(blocks: DataFrame, documents: int, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """(lang, prefix, docs) of the complete terms in ``documents`` or more documents, a written table.

    A term is in no more documents than each of its prefixes, so each level extends the prefixes of the level before
    that were in enough documents and counts them exactly; terms that end inside a level are their own prefix.
    """
    parents, last = None, None
    for size in (*levels, None):
        kept = written(_documents(blocks, size, parents).where(F.col("docs") >= documents), "prefixes")
        dropped(last)
        if parents:
            parents.sent.destroy()
        last = kept
        parents = PrefixMap(kept, size) if size is not None else None
    return last


def _counts(blocks: DataFrame, kept: PrefixMap) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, held in _held(batches):
            held.keep(kept.may_hold(lang, held.terms))
            told = held.terms.dictionary_encode()
            width = max(len(told.dictionary), 1)
            each, place = np.unique(held.source[held.doc] * np.int64(width) + told.indices.to_numpy(zero_copy_only=False)[held.term], return_inverse=True)
            n = np.zeros(len(each), np.int64)
            np.add.at(n, place, held.n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(each), pa.string()), held.sources.take(pa.array(each // width)), told.dictionary.take(pa.array(each % width)), pa.array(n)], ["lang", "source", "prefix", "n"]
            )

    return blocks.mapInArrow(run, "lang string, source string, prefix binary, n long").groupBy("lang", "source", "prefix").agg(F.sum("n").alias("n"))


def shares(count: np.ndarray, total: np.ndarray | int, terms: int) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / (total + 2 terms)): a long division in base 1000, exact below 9 x 10^15 terms."""
    whole = np.asarray(total, np.int64) + 2 * terms
    out, rest = np.divmod(count.astype(np.int64) + 2, whole)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + digit
    return out + 1


def differences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q))"""
    return (p - q) ** 2 // (p + q)


_FOUND = "lang string, at int, other int, item binary, value long"


def _compared(rows: DataFrame, top: int) -> DataFrame:
    """From (lang, item, places, counts, terms, total, totals): for each two sources ``at`` < ``other`` the sum of
    differences over the rows of a batch, and for each source the ``top`` terms of the batch that it favours."""

    def one(rows: pa.RecordBatch) -> Iterator[tuple[list, list, list, list]]:
        terms, total = rows.column("terms")[0].as_py(), rows.column("total")[0].as_py()
        totals = rows.column("totals")[0].values.to_numpy()
        counts = np.zeros((rows.num_rows, len(totals)), np.int64)
        sizes = pc.list_value_length(rows.column("places")).to_numpy(zero_copy_only=False)
        counts[np.repeat(np.arange(rows.num_rows), sizes), rows.column("places").flatten().to_numpy()] = rows.column("counts").flatten().to_numpy()
        p, q = shares(counts, totals, terms), shares(counts.sum(1), total, terms)
        names = rows.column("item")
        for s in range(len(totals)):
            if s + 1 < len(totals):
                yield [s] * (len(totals) - s - 1), list(range(s + 1, len(totals))), [None] * (len(totals) - s - 1), differences(p[:, s : s + 1], p[:, s + 1 :]).sum(0).tolist()
            own = np.flatnonzero((counts[:, s] > 0) & (p[:, s] > q))
            value = differences(p[own, s], q[own])
            if len(own) > top:  # ties at the end stay
                stay = value >= np.partition(value, len(value) - top)[len(value) - top]
                own, value = own[stay], value[stay]
            yield [s] * len(own), [None] * len(own), names.take(pa.array(own)).to_pylist(), value.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, own in _by_lang(batches):
            step = max(1, CELLS // max(1, len(own.column("totals")[0])))
            for i in range(0, own.num_rows, step):
                columns: list[list] = [[], [], [], []]
                for part in one(own.slice(i, step)):
                    for column, values in zip(columns, part, strict=True):
                        column += values
                kinds = (pa.int32(), pa.int32(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(columns[0]), pa.string()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["lang", "at", "other", "item", "value"])

    return rows.mapInArrow(run, _FOUND)


def source_divergence(docs: DataFrame, documents: int = 10, top: int = 10, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """(lang, source, part, item, value, rank) from the columns lang, source and text.

    A language keeps the terms in ``documents`` or more of its documents.  Part ``pair`` gives the distance to each other
    source of the language over all kept terms, part ``term`` the ``top`` terms that the source uses more than its
    language.  All arithmetic is in whole numbers.

    Each row is a document, repeated rows count each; null lang, source and text are empty strings, an empty text has no
    terms but its group is there; texts and terms of any length are read whole; ties are ranked by the bytes of the item;
    an empty table gives an empty one; other columns aren't read.  A task holds the counts of one language's sources for
    one term at least.
    """
    blocks = written(term_blocks(docs), "blocks", GROUP_ROWS)
    kept = kept_terms(blocks, documents, levels)
    few = PrefixMap(kept, None)
    cells = written(_counts(blocks, few).join(kept.select("lang", "prefix"), ["lang", "prefix"], "left_semi"), "cells")
    few.sent.destroy()
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    every = blocks.select("lang", F.explode("sources").alias("source")).distinct()
    order = W.partitionBy("lang").orderBy("source")  # a row per source
    groups = written(every.join(sums, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), (F.row_number().over(order) - 1).alias("at")), "groups")
    dropped(blocks)
    listed = F.array_sort(F.collect_list(F.struct("at", "total")))
    langs = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.transform(listed, lambda x: x["total"]).alias("totals"))
    langs = written(langs.join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms")), "lang"), "langs")
    dropped(kept)
    held = F.collect_list(F.struct("at", "n"))
    by_term = cells.join(groups.select("lang", "source", "at"), ["lang", "source"]).groupBy("lang", F.col("prefix").alias("item")).agg(held.alias("h"))
    by_term = by_term.select("lang", "item", F.col("h.at").alias("places"), F.col("h.n").alias("counts"))
    found = written(_compared(by_term.join(langs, "lang"), top), "found")
    dropped(cells, langs)
    names = groups.select("lang", "source", "at")
    sums = found.where("other IS NOT NULL").groupBy("lang", "at", "other").agg(F.sum("value").alias("value"))
    both = sums.union(sums.select("lang", F.col("other").alias("at"), F.col("at").alias("other"), "value"))
    pairs = names.join(names.select("lang", F.col("source").alias("item"), F.col("at").alias("other")), "lang").where("at <> other")
    pairs = pairs.join(both, ["lang", "at", "other"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    best = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(best))
    terms = found.where("other IS NULL").join(names, ["lang", "at"]).select("lang", "source", F.lit("term").alias("part"), F.col("item").cast("string").alias("item"), "value")
    return pairs.unionByName(terms.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top))
