"""N-gram Jaccard self-join by prefix trees: groups of documents whose shingle sets overlap almost fully."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._io import dropped, may_occur, swept, written
from ._words import NOT_SPACE, Words, list_array, mixed, shingles, sliced
from .components import connected_components

#: Slots of the table that says how common a token is: one byte each, sent to all tasks whatever the input's size.
SLOTS = 1 << 21
#: Prefixes are longer by so many tokens, and linking sets must share so many more inside them: sets that share a common
#: phrase alone are no candidates.
SHARE = 6
#: Bytes of texts whose tokens a task counts at a time.
COUNTED = 16_000_000
#: Rounds that test each class against one leader of its blocks before the tries take the rest.
ROUNDS = 2
#: Sets that one trie holds; a larger block is dealt out as a grid of such cells.
CELL = 2_000
#: Texts that a task holds to test their pairs.
HELD = 256
#: Ratio of the sizes within one band of set sizes.
BAND = 1.02


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingles (63-bit hashes): of k words, or of all words if there are fewer.

    A-Z count as a-z; words are ``[^\\x20\\x09-\\x0D]+``.  Two shingles count as one if all 63 bits agree.
    """
    words = Words(column, NOT_SPACE, lower=True)
    for a, n in zip(words.first.tolist(), words.count.tolist(), strict=False):
        h = shingles(words.hash[a : a + n], min(n, k)) if n else np.zeros(0, np.uint64)
        if 0 < n < k:
            h = h ^ np.uint64(n)
        yield np.unique(h >> np.uint64(1))


class Rule:
    """What 100 * intersection >= percent * union asks of sizes and overlaps; prefixes stand in the global order.

    Sets x and y of sizes a and b link exactly if they share ``overlap(a, b)`` tokens.  A set of size a shares ``least(a)``
    at least with any set that it links with.  Its prefix is all but its last ``least(a) - extra(a)`` tokens.  Let x be
    the one whose prefix ends first.  Each shared token inside x's prefix is inside y's too, and x has ``least(a) -
    extra(a)`` tokens after its prefix; so linking sets share ``overlap(a, b) - least(a) + extra(a)`` tokens inside both
    prefixes: ``inside(a, b)``.
    """

    def __init__(self, percent: int):
        self.percent = percent

    def least(self, a):
        return -(-a * self.percent // 100)

    def extra(self, a):
        return np.minimum(SHARE, self.least(a))

    def prefix(self, a):
        return a - self.least(a) + self.extra(a)

    def near(self, a, b):
        return 100 * np.minimum(a, b) >= self.percent * np.maximum(a, b)

    def overlap(self, a, b):
        return -(-self.percent * (a + b) // (100 + self.percent))

    def inside(self, a, b):
        return self.overlap(a, b) - self.least(a) + self.extra(a)

    def inside_any(self, a, low, high):
        """At most ``inside`` of either set, for every near partner of a size from ``low`` to ``high``."""
        low, high = np.maximum(low, self.least(a)), np.minimum(high, 100 * a // self.percent)
        first = self.inside(a, low)
        # Over b: percent * (a + b) / (100 + percent) - percent * b / 100 falls, extra(b) rises.
        second = np.floor(self.percent * (a + high) / (100 + self.percent) - self.percent * high / 100) - 1 + self.extra(low)
        return np.maximum(1, np.minimum(first, second))


class PrefixTree:
    """Ascending token sequences, stored once for each common beginning.

    A node holds a run of tokens, the longest rest, the sizes and the group of what is below it.
    """

    __slots__ = ("run", "children", "ends", "low", "high", "rest", "group")

    def __init__(self, run: np.ndarray, entry: tuple):
        self.run, self.children, self.ends = run, {}, []
        self.low = self.high = entry[1]
        self.rest, self.group = 0, entry[3]

    def _take(self, entry: tuple, rest: int) -> None:
        self.low, self.high, self.rest = min(self.low, entry[1]), max(self.high, entry[1]), max(self.rest, rest)
        if self.group != entry[3]:
            self.group = None

    def add(self, tokens: np.ndarray, entry: tuple) -> None:
        """``entry``: (key, size of the set, end of its prefix, group)."""
        node, at, n = self, 0, len(tokens)
        while True:
            node._take(entry, n - at)
            if at == n:
                node.ends.append(entry)
                return
            child = node.children.get(int(tokens[at]))
            if child is None:
                child = node.children[int(tokens[at])] = PrefixTree(tokens[at:], entry)
                child.ends.append(entry)
                return
            m = min(len(child.run), n - at)
            differ = np.flatnonzero(child.run[:m] != tokens[at : at + m])
            same = int(differ[0]) if len(differ) else m
            if same < len(child.run):
                upper = PrefixTree(child.run[:same], entry)
                upper.low, upper.high, upper.group, upper.rest = child.low, child.high, child.group, child.rest + len(child.run) - same
                child.run = child.run[same:]
                upper.children[int(child.run[0])] = child
                node.children[int(tokens[at])] = child = upper
            node, at = child, at + same

    def candidates(self, tokens: np.ndarray, entry: tuple, rule: Rule) -> Iterator[object]:
        """Keys of the stored sequences that share enough tokens with this one and are of another group.

        The overlap of a path is counted once for all below it.  A subtree is left when it is of the same group, when no
        size in it is near, or when the overlap and the tokens that both sides still have can't reach what is asked.
        """
        _, a, end, group = entry
        n, todo = len(tokens), [(c, 0, 0) for c in self.children.values()]
        while todo:
            node, met, used = todo.pop()
            if (node.group is not None and node.group == group) or not rule.near(a, min(max(a, node.low), node.high)):
                continue
            asked = rule.inside_any(a, node.low, node.high)
            if met + min(len(node.run) + node.rest, n - used) < asked:
                continue
            at = np.searchsorted(tokens, node.run)
            met += int((tokens[np.minimum(at, n - 1)] == node.run).sum())
            used = int(np.searchsorted(tokens, node.run[-1], "right"))
            for key, b, end_b, other in node.ends:
                if (other != group or group is None) and rule.near(a, b) and met >= (rule.inside(a, b) if end <= end_b else rule.inside(b, a)):
                    yield key
            if met + min(node.rest, n - used) >= asked:
                todo += [(c, met, used) for c in node.children.values()]


def _common(docs: DataFrame, text: str, k: int) -> np.ndarray:
    """How common the tokens of each slot are: the bit length of the number of times.

    A token counts where three documents or more of ``COUNTED`` bytes of an Arrow batch have it.  This only decides the global order (common
    tokens last), never the result; a rare token in the slot of a common one comes late too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 0, COUNTED):
            sets = [s for part in sliced([batch], 0) for s in shingle_sets(part.column(0), k)]
            tokens, times = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_counts=True)
            many = times >= 3
            yield pa.RecordBatch.from_arrays([pa.array((tokens[many] % np.uint64(SLOTS)).astype(np.int32)), pa.array(times[many])], ["slot", "times"])

    counts = docs.select(text).mapInArrow(run, "slot int, times long").groupBy("slot").agg(F.length(F.bin(F.sum("times"))).cast("tinyint").alias("bits"))
    rows = counts.toArrow()  # SLOTS rows at most
    out = np.zeros(SLOTS, np.uint8)
    out[rows.column("slot").to_numpy()] = rows.column("bits").to_numpy()
    return out


def _signatures(docs: DataFrame, key: str, text: str, k: int, rule: Rule, common) -> DataFrame:
    """Per document: its size, a 128-bit digest of its set, and the prefix of the set in the global order.

    The order is that of keys: the slot's commonness, then 57 bits of the token.  Where two tokens have one key, prefixes
    seem to share more than they do, never less, and whole sets decide.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = common.value.astype(np.uint64) << np.uint64(57)
        for batch in sliced(batches, 1):
            sizes, digests, prefixes = [], [], []
            for s in shingle_sets(batch.column(1), k):
                sizes.append(n := len(s))
                digests.append((s.sum(dtype=np.uint64), np.bitwise_xor.reduce(mixed(s)) if n else np.uint64(0)))
                keys = bits[s % np.uint64(SLOTS)] | s >> np.uint64(6)
                m = rule.prefix(n)
                prefixes.append(np.sort(np.partition(keys, m - 1)[:m]) if 0 < m < n else np.sort(keys))
            flat = np.concatenate([*prefixes, np.zeros(0, np.uint64)]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *(pa.array(np.array([d[j] for d in digests], np.uint64).view(np.int64)) for j in (0, 1)), list_array(flat, np.array([len(p) for p in prefixes], np.int64), pa.int64())], ["doc", "n", "h1", "h2", "prefix"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc"), text).mapInArrow(run, f"doc {kind}, n long, h1 long, h2 long, prefix array<long>")


def _linked(pairs: DataFrame, docs: DataFrame, key: str, text: str, k: int, rule: Rule, stars: bool) -> DataFrame:
    """Of the pairs (a, b), those whose sets link.

    ``stars``: few a have most of the pairs.  Otherwise pairs that hang together form a group, and each text travels
    once to its group if that has ``HELD`` texts at most.  Larger groups, and stars, are taken apart: the pairs of one a
    are dealt out over cells of about ``HELD``, where a's text comes once.
    """
    kind = docs.schema[key].dataType.simpleString()
    made = []
    dealt = pairs.select("a", "b", F.col("a").alias("home"))
    if not stars:
        groups = connected_components(pairs)
        small = groups.groupBy("component").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") <= HELD).select("component")
        homes = groups.join(small, "component").select(F.col("node").alias("a"), F.col("component").alias("own"))
        dealt = pairs.join(homes, "a", "left").select("a", "b", F.coalesce("own", "a").alias("home"), F.col("own").isNotNull().alias("whole"))
        made.append(groups)
    else:
        dealt = dealt.withColumn("whole", F.lit(False))
    sizes = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / HELD).alias("cells")).where("cells > 1")
    cell = F.when(F.col("whole"), 0).otherwise(F.coalesce(F.pmod(F.xxhash64("b"), "cells"), F.lit(0)))
    dealt = written(dealt.join(sizes, "a", "left").select("a", "b", "home", cell.alias("cell")), "cells")
    # A row per text and cell, with the partners of those that are a.
    ends = dealt.select("home", "cell", F.col("a").alias("id"), F.col("b").alias("other")).union(dealt.select("home", "cell", "b", F.lit(None)))
    asked = written(ends.groupBy("home", "cell", "id").agg(F.collect_list("other").alias("others")), "asked")
    texts = may_occur(docs.select(F.col(key).alias("id"), F.col(text).alias("text")), "id", asked.select("id"), "_may").where("_may").drop("_may")
    rows = asked.join(texts, "id").repartition("home", "cell").sortWithinPartitions("home", "cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {}
        for batch in sliced(batches, "text"):
            out: list[tuple] = []
            places = zip(*(batch.column(c).to_pylist() for c in ("home", "cell", "id", "others")), strict=True)
            for (home, cell, id_, others), own in zip(places, shingle_sets(batch.column("text"), k), strict=True):
                if (home, cell) != at:
                    out += _met(held, rule)
                    at, held = (home, cell), {}
                held[id_] = (own, others)
            yield _pairs_batch(out, batch.schema.field("id").type)
        if held:
            yield _pairs_batch(_met(held, rule), batch.schema.field("id").type)

    links = written(rows.select("home", "cell", "id", "others", "text").mapInArrow(run, f"a {kind}, b {kind}"), "links")
    dropped(dealt, asked, *made)
    swept(docs.sparkSession)
    return links


def _met(held: dict, rule: Rule) -> list[tuple]:
    """The pairs of one cell whose sets link."""
    out = []
    for a, (own, others) in held.items():
        for b in others:
            s = held[b][0]
            if len(s) and len(own):
                met = int((own[np.minimum(np.searchsorted(own, s), len(own) - 1)] == s).sum())
                if met >= rule.overlap(len(s), len(own)):
                    out.append((a, b))
    return out


def _pairs_batch(pairs: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], kind) for i in (0, 1)], ["a", "b"])


def _leaders(held: DataFrame, labels: DataFrame | None) -> DataFrame:
    """For each class at most one pair (a, b): b the class, a the leader of the most of its blocks that isn't connected
    with it.  A block's leader is the class with the fewest tokens that no other class has: the middle of a family."""
    rows = _labelled(held, labels).select("rep", "n", "comp", (F.size("tokens") - F.col("length")).alias("clean"), F.explode("tokens").alias("token"))
    spread = rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(F.struct("clean", -F.col("n"), "rep", "comp", "n")).alias("o")).where("lo < hi")
    met = rows.join(spread.select("token", "o.*").withColumnsRenamed({"rep": "rep_a", "comp": "comp_a", "n": "n_a"}).drop("clean"), "token").where("comp <> comp_a")
    pairs = met.groupBy("rep", "rep_a").agg(F.count(F.lit(1)).alias("shared"), F.first("n").alias("n"), F.first("n_a").alias("n_a"))
    return pairs.groupBy(F.col("rep").alias("b")).agg(F.max(F.struct("shared", "rep_a", "n", "n_a")).alias("o")).select(F.col("o.rep_a").alias("a"), "b", F.col("o.n").alias("n"), F.col("o.n_a").alias("n_a"))


def _labelled(held: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return held.withColumn("comp", F.col("rep"))
    return held.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")


def _candidates(held: DataFrame, labels: DataFrame | None, rule: Rule, key_type: str) -> DataFrame:
    """Pairs (a, b) of classes that aren't connected and share as many tokens of their prefixes as linking sets must.

    A class is in the block of each of its tokens with the tokens from there on.  It leaves a block that has no class of
    another component, in any band of near sizes, with tokens enough: families that are connected, and sets with too many
    tokens of their own, are gone before anything is paired.  What is left of each block goes into a prefix tree.
    """
    p = rule.percent
    rows = _labelled(held, labels).select("rep", "n", "comp", F.size("tokens").alias("size"), F.posexplode("tokens").alias("pos", "token"))
    rows = rows.select("rep", "n", "comp", "token", "pos", (F.col("size") - F.col("pos")).alias("c"))
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(BAND))).cast("int")
    rows = written(rows.withColumn("band", band), "rows")
    bands = rows.groupBy("token", "band").agg(F.max("c").alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("n").alias("low"), F.max("n").alias("high"))
    bands = bands.groupBy("token").agg(F.collect_list(F.struct("c", "lo", "hi", "low", "high")).alias("bands")).where("size(bands) > 1 OR bands[0].lo < bands[0].hi")

    def asked(b: Column) -> Column:
        """``Rule.inside_any`` as a column."""
        n, least = F.col("n"), F.ceil(F.col("n") * p / 100)
        low, high = F.greatest(b["low"], least), F.least(b["high"], F.floor(100 * n / p))
        extra = lambda x: F.least(F.lit(SHARE), F.ceil(x * p / 100))
        first = F.ceil(p * (n + low) / (100 + p)) - least + extra(n)
        second = F.floor(p * (n + high) / (100 + p) - p * high / 100) - 1 + extra(low)
        return F.when(low > high, 1 << 30).otherwise(F.greatest(F.lit(1), F.least(first, second)))

    open_ = F.exists("bands", lambda b: ((b["lo"] != F.col("comp")) | (b["hi"] != F.col("comp"))) & (F.least(b["c"], F.col("c")) >= asked(b)))
    left = opened = written(rows.join(bands, "token").where(open_).select("token", "rep", "comp", "pos"), "open")
    spread = left.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("cells")).where("lo < hi")
    left = left.join(spread.select("token", "cells"), "token")
    whole = held.select("rep", "n", "end", "tokens")
    blocks = left.join(whole, "rep").select("token", "cells", "rep", "n", "comp", "end", F.slice("tokens", F.col("pos") + 1, F.size("tokens")).alias("tokens"))
    # Cell (i, j) has the sets of parts i and j of a block, and pairs them across; (i, i) pairs part i with itself.
    part = F.pmod(F.xxhash64("rep"), "cells").cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("cells") - 1), lambda j: F.struct(F.least("part", j).alias("i"), F.greatest("part", j).alias("j")))
    blocks = blocks.withColumn("part", part).withColumn("cell", F.explode(cells)).withColumns({"i": F.col("cell.i"), "j": F.col("cell.j")})
    dealt = blocks.select("token", "i", "j", "part", "rep", "n", "comp", "end", "tokens").repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "part", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block, kind = None, [], None
        for batch in batches:
            out, kind = [], batch.schema.field("rep").type
            tokens = batch.column("tokens")
            flat, offsets = tokens.values.to_numpy(), tokens.offsets.to_numpy()
            columns = (batch.column(c).to_pylist() for c in ("token", "i", "j", "part", "rep", "n", "end", "comp"))
            for r, (token, i, j, part, *entry) in enumerate(zip(*columns, strict=True)):
                if (token, i, j) != at:
                    out += _block_pairs(block, rule)
                    at, block = (token, i, j), []
                block.append((part != j, part == i, tuple(entry), flat[offsets[r] : offsets[r + 1]]))
            yield _pairs_batch(out, kind)
        if block:
            yield _pairs_batch(_block_pairs(block, rule), kind)

    found = written(dealt.mapInArrow(run, f"a {key_type}, b {key_type}").distinct(), "pairs")
    dropped(rows, opened)
    return found


def _block_pairs(block: list[tuple], rule: Rule) -> list[tuple]:
    """Candidates among the sets of one cell: a tree of part i, which the sets of part j walk through."""
    out, tree = [], None
    for stays, planted, entry, tokens in block:
        if tree is None:
            tree = PrefixTree(tokens[:0], entry)
        if not stays:
            out += [(min(entry[0], y), max(entry[0], y)) for y in tree.candidates(tokens, entry, rule)]
        if planted:
            tree.add(tokens, entry)
    return out


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, rounds: int = ROUNDS) -> DataFrame:
    """(key, n_shingles, component_id): documents linked when 100 * intersection >= percent * union of their shingle
    sets; the component is the smallest key reachable by links, itself included.

    Null and empty texts have size 0 and link with nothing; equal sets always link; rows with the same key count as one
    document, that with the smallest text, and all get its result; so do rows without a key, whose component is null
    unless their text has copies; very long texts are cut into batches of their own,
    never shortened; an empty table gives an empty one; only the two columns are read.

    1. Equal sets (128 bits over 63-bit shingles) become one class each; its representative is the smallest key.
    2. Classes that share a token of their prefixes form blocks.  In each round every class is tested against one
       leader of its blocks, and what links is connected: a large block of copies collapses without listing its pairs.
    3. Prefix trees over what is left of each block give the pairs that may still link; whole sets decide.
    No pair that could link is left out, and pairs inside a component aren't needed.
    """
    rule, spark = Rule(percent), docs.sparkSession
    given = docs.select(key, text)
    repeated = not docs.groupBy(key).count().where("count > 1").isEmpty()
    docs = given.groupBy(key).agg(F.min(text).alias(text)) if repeated else given
    common = spark.sparkContext.broadcast(_common(docs, text, k))
    signed = written(_signatures(docs, key, text, k, rule, common), "sets")
    alike = ["n", "h1", "h2"]
    classes = written(signed.where("n > 0").groupBy(*alike).agg(F.min("doc").alias("rep"), F.first("prefix").alias("prefix")), "classes")
    kind = given.schema[key].dataType.simpleString()
    members = written(signed.select("doc", *alike), "members")
    dropped(signed)
    tokens = classes.select("rep", F.explode("prefix").alias("token"))
    shared = written(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("_m")).where("_m > 1").select("token"), "tokens")
    kept = tokens.join(shared, "token").groupBy("rep").agg(F.array_sort(F.collect_list("token")).alias("tokens"))
    sizes = classes.select("rep", "n", F.size("prefix").alias("length"), F.element_at("prefix", -1).alias("end"))
    held = written(kept.join(sizes, "rep"), "held")
    ids = written(classes.select("rep", *alike), "ids")
    dropped(shared, classes)
    swept(spark)
    links = labels = None
    for r in range(rounds + 1):
        if r < rounds:
            pairs = written(_leaders(held, labels).where(f"100 * least(n, n_a) >= {percent} * greatest(n, n_a)").select("a", "b"), "pairs")
        else:
            pairs = _candidates(held, labels, rule, kind)
        found = None if pairs.isEmpty() else _linked(pairs, docs, key, text, k, rule, r < rounds)
        dropped(pairs)
        if found is None:
            continue
        links = found if links is None else links.unionByName(found)
        dropped(labels)
        labels = connected_components(links)
    dropped(held)
    if labels is None:
        ids = ids.withColumn("component_id", F.col("rep"))
    else:
        ids = ids.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component_id", F.coalesce("component", "rep"))
    whole = members.join(ids.select(*alike, "component_id"), alike, "left")
    whole = whole.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc").alias("component_id"))
    if not repeated:
        return whole
    named = whole.withColumnRenamed(key, "_key")
    return given.select(key).join(named, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
