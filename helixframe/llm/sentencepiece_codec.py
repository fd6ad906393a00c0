"""SentencePiece BPE encoding by vectorised merge rounds, and decoding."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._words import gather, list_array

SPACE = "▁"
_NONE = np.iinfo(np.int32).max


class _PairTable:
    """Maps pairs of symbols to the piece that they make: two probes of hash tables without collisions."""

    BITS = 21

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys = np.concatenate((keys, [-1])).astype(np.int64)
        self.values = np.concatenate((values, [-1])).astype(np.int32)
        self.shift = np.uint64(64 - self.BITS)
        rng, left, self.tables = np.random.default_rng(1), np.arange(len(keys)), []
        while len(left):
            by = rng.integers(1 << 62, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            slot = self._slot(keys[left], by)
            _, one = np.unique(slot, return_index=True)
            at = np.full(1 << self.BITS, len(keys), np.int32)
            at[slot[one]] = left[one]
            self.tables.append((by, at))
            left = np.delete(left, one)

    def _slot(self, keys: np.ndarray, by: np.uint64) -> np.ndarray:
        return ((keys.astype(np.uint64) * by) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, or -1."""
        out = np.full(len(keys), -1, np.int32)
        for by, at in self.tables:
            i = at[self._slot(keys, by)]
            hit = self.keys[i] == keys
            out[hit] = self.values[i[hit]]
        return out


class PieceBpe:
    """Encoder for BPE models of the sentencepiece library whose normaliser only marks spaces."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size, self.eos = sp.vocab_size(), sp.eos_id()
        plain = [i for i in range(self.size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        pieces = {sp.id_to_piece(i): i for i in plain}
        if sp.encode("a  b") == sp.encode("a b") or any(" " in p for p in pieces):
            raise ValueError("only models that keep all spaces can be encoded")
        self.byte = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        score = {i: sp.get_score(i) for i in plain}
        order = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.rank = np.full(self.size + 1, _NONE, np.int32)
        for i, s in score.items():
            self.rank[i] = order[s]
        # A symbol is a piece's id, or for a character that is no piece, size + code point.
        self.char = np.arange(0x110000, dtype=np.int32) + self.size
        for p, i in pieces.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        symbol = lambda s: pieces.get(s, self.size + ord(s) if len(s) == 1 else -1)
        keys, made, touching = [], [], set()
        for p, i in pieces.items():
            for k in range(1, len(p)):
                touching.add((ord(p[k - 1]) << 21) | ord(p[k]))
                a, b = symbol(p[:k]), symbol(p[k:])
                if a >= 0 and b >= 0:
                    keys.append((a << 21) | b)
                    made.append(i)
        self.pairs = _PairTable(np.array(keys, np.int64), np.array(made, np.int32))
        found = np.array(sorted(touching), np.int64)
        self.touching = _PairTable(found, np.zeros(len(found), np.int32))

    def _merge(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        made = self.pairs.find((left.astype(np.int64) << 21) | right)
        return made, self.rank[made]  # rank[-1] is _NONE

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and the number of ids of each.

        Words are cut further wherever no piece holds the two neighbouring characters.  In each round every segment
        merges its best pair: all leftmost occurrences at once, up to the first that makes a pair as good or better,
        which the next round then sees.  Segments without a pair leave; the arrays are compacted.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        if not len(code):
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        cut = np.ones(len(code), bool)
        cut[1:] = self.touching.find((code[:-1] << 21) | code[1:]) < 0
        cut[np.cumsum(sizes)[:-1][sizes[1:] > 0]] = True
        segment = np.cumsum(cut) - 1
        word = np.repeat(np.arange(len(words)), sizes)
        sym, seg, origin = self.char[code], segment, np.arange(len(code))
        ended: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            joined = np.empty(len(sym), bool)
            joined[-1] = False
            np.equal(seg[:-1], seg[1:], out=joined[:-1])
            at = np.flatnonzero(joined)
            made = np.full(len(sym), -1, np.int32)
            rank = np.full(len(sym), _NONE, np.int32)
            made[at], rank[at] = self._merge(sym[at], sym[at + 1])
            heads = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
            length = np.diff(np.concatenate((heads, [len(sym)])))
            best = np.minimum.reduceat(rank, heads)
            over = np.repeat(best == _NONE, length)
            if over.any():
                ended.append((origin[over], sym[over]))
            pick = np.flatnonzero((rank == np.repeat(best, length)) & ~over)
            if not len(pick):
                break
            pick = self._together(pick, sym, seg, made, rank)
            sym = sym.copy()
            sym[pick] = made[pick]
            keep = ~over
            keep[pick + 1] = False
            sym, seg, origin = sym[keep], seg[keep], origin[keep]
        place = np.concatenate([o for o, _ in ended])
        ids = np.concatenate([s for _, s in ended])
        order = np.argsort(place, kind="stable")
        return self._bytes(ids[order], word[place[order]], len(words))

    def _together(self, pick, sym, seg, made, rank) -> np.ndarray:
        """Of the best pairs, those that one-by-one merging from the left would also merge before anything else."""
        run = np.concatenate(([True], np.diff(pick) != 1))
        first = pick[np.flatnonzero(run)][np.cumsum(run) - 1]
        pick = pick[(pick - first) % 2 == 0]
        many = np.zeros(len(pick), bool)
        same = seg[pick[1:]] == seg[pick[:-1]]
        many[1:] |= same
        many[:-1] |= same
        if not many.any():
            return pick
        some = np.flatnonzero(many)
        p, n = pick[some], len(sym)
        new, top = made[p], rank[p]
        before = p - 1
        left = sym[np.maximum(before, 0)].copy()
        near = np.concatenate(([False], p[1:] - p[:-1] == 2))
        left[near] = new[np.flatnonzero(near) - 1]
        _, with_left = self._merge(left, new)
        with_left[(before < 0) | (seg[np.maximum(before, 0)] != seg[p])] = _NONE
        after = np.minimum(p + 2, n - 1)
        _, with_right = self._merge(new, sym[after])
        with_right[(p + 2 >= n) | (seg[after] != seg[p])] = _NONE
        stop = (np.minimum(with_left, with_right) <= top).astype(np.int64)
        earlier = np.cumsum(stop) - stop
        heads = np.flatnonzero(np.concatenate(([True], seg[p[1:]] != seg[p[:-1]])))
        earlier -= np.repeat(earlier[heads], np.diff(np.concatenate((heads, [len(p)]))))
        keep = np.ones(len(pick), bool)
        keep[some[earlier > 0]] = False
        return pick[keep]

    def _bytes(self, ids: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Characters that are no piece become the ids of their UTF-8 bytes."""
        odd = ids >= self.size
        if odd.any():
            point = ids[odd] - self.size
            size = np.ones(len(ids), np.int64)
            size[odd] = 1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF)
            raw = np.frombuffer(point.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass"), np.uint8)
            where = np.repeat(odd, size)
            ids, word = np.repeat(ids, size), np.repeat(word, size)
            ids[where] = self.byte[raw]
        return ids.astype(np.int32), np.bincount(word, minlength=n)

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.sp.decode(ids) if ids else []


@lru_cache(2)
def load(path: str) -> PieceBpe:
    return PieceBpe(path)


class _Seen(dict):
    """Numbers words as they come and keeps the new ones."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class WordCache:
    """Ids of words met before.  ``limit`` bounds its memory: beyond it the cache starts afresh."""

    def __init__(self, encode, limit: int = 400_000):
        self.encode, self.limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        self.seen, self.ids, self.sizes = _Seen(), np.zeros(0, np.int32), np.zeros(0, np.int64)

    def batch(self, words: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of ids of each."""
        if len(self.seen) > self.limit:
            self._clear()
        get = self.seen.__getitem__
        at: list[int] = []
        for text in words:
            at.extend(map(get, text))
        at = np.array(at, np.int64)
        if self.seen.new:
            ids, sizes = self.encode(self.seen.new)
            self.ids, self.sizes = np.concatenate((self.ids, ids)), np.concatenate((self.sizes, sizes))
            self.seen.new = []
        starts = np.cumsum(self.sizes) - self.sizes
        size = self.sizes[at]
        text = np.repeat(np.arange(len(words)), [len(x) for x in words])
        return self.ids[gather(starts[at], size)], np.bincount(text, size, len(words)).astype(np.int64)


@lru_cache(2)
def _cache(path: str) -> WordCache:
    """Kept as long as the Python worker lives, over tasks."""
    return WordCache(load(path).encode_words)


def slices(texts: list[str], limit: int = 1_000_000) -> Iterator[list[str]]:
    """Runs of texts of together about ``limit`` characters at most (or one longer text).  Words, ids and symbol arrays
    take some fifty bytes a character, and a reused Python worker keeps what it has once taken."""
    part, total = [], 0
    for t in texts:
        if part and total + len(t) > limit:
            yield part
            part, total = [], 0
        part.append(t)
        total += len(t)
    if part:
        yield part


def encode_decode(df: DataFrame, model_path: str, text: str = "text", ids: str = "ids", decoded: str | None = "decoded", add_eos: bool = True) -> DataFrame:
    """Adds the ids of each text (``array<int>``), as the library gives them, and the text decoded from them.

    Null texts count as empty: only the end id, decoded to the empty text.  Nothing is shuffled, and a text is never
    cut; repeated rows all stay; an empty table gives an empty one.  Input columns called like the new ones are replaced.
    """
    keep = [c for c in df.columns if c not in (ids, decoded)]
    from pyspark.sql import types as T

    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)] + ([T.StructField(decoded, T.StringType(), False)] if decoded else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, cache = load(model_path), _cache(model_path)
        for batch in batches:
            done = 0
            for part in slices([t or "" for t in batch.column(text).to_pylist()]):
                # Cut before each run of spaces: no piece holds a space after another character.
                marked = [(" " + t).replace(" ", SPACE) if t else "" for t in part]
                flat, size = cache.batch([_split(m) for m in marked])
                if add_eos:
                    flat = np.insert(flat, np.cumsum(size), bpe.eos)
                    size = size + 1
                rows = batch.slice(done, len(part))
                done += len(part)
                columns = [rows.column(c) for c in keep] + [list_array(flat, size, pa.int32())]
                if decoded:
                    each = flat.tolist()
                    to = np.cumsum(size).tolist()
                    columns.append(pa.array(bpe.decode([each[b - n : b] for b, n in zip(to, size.tolist(), strict=True)]), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, [*keep, ids, *([decoded] if decoded else [])])

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def _split(marked: str) -> list[str]:
    """Words, each with the spaces before it."""
    head, *words = marked.split(SPACE)
    if "" not in words:
        return ([head] if head else []) + [SPACE + w for w in words]
    out, spaces = ([head] if head else []), ""
    for w in words:
        spaces += SPACE
        if w:
            out.append(spaces + w)
            spaces = ""
    return out + ([spaces] if spaces else [])
