"""Column functions and jobs over DNA and protein sequences: GC content, peptides, guides, mutants."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.cohort import priority

# The standard genetic code in TCAG order; preferred residues by place in a peptide; preferred bases by
# place in a spacer.
_BASES = "TCAG"
_AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = {a + b + c: _AMINO[16 * i + 4 * j + k] for i, a in enumerate(_BASES) for j, b in enumerate(_BASES) for k, c in enumerate(_BASES)}

ANCHORS = {
    0: {"L": 0.8, "M": 0.7, "I": 0.6, "V": 0.5, "A": 0.4},
    1: {"L": 0.9, "M": 0.8, "V": 0.7, "I": 0.6, "A": 0.5},
    8: {"V": 0.9, "L": 0.8, "I": 0.7, "A": 0.6, "T": 0.5},
}
POSITION_WEIGHTS = {
    0: {"G": 0.10, "A": 0.00, "T": -0.05, "C": 0.05},
    1: {"G": 0.08, "A": -0.02, "T": -0.04, "C": 0.02},
    19: {"G": 0.12, "A": 0.00, "T": -0.08, "C": 0.04},
}


def gc_content(seq: Column) -> Column:
    return F.when(F.length(seq) > 0, (F.length(seq) - F.length(F.regexp_replace(F.upper(seq), "[GC]", ""))) / F.length(seq)).otherwise(0.0)


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(F.regexp_replace(F.upper(seq), "[^ACGTN]", "N")), "ACGT", "TGCA")


def gc_windows(df: DataFrame, width: int = 200, step: int = 100, least: float = 0.6) -> DataFrame:
    """Full windows with a GC content of at least ``least``: (gene, start, gc).

    A text is cut once into blocks as long as the largest common divisor of width and step; a window adds the counts of
    its blocks.
    """
    block = math.gcd(width, step)
    m = width // block
    rows = df.select("gene", F.transform(F.regexp_extract_all("seq", F.lit(f"(?s).{{{block}}}"), F.lit(0)), lambda b: F.length(F.regexp_replace(F.upper(b), "[^GC]", ""))).alias("_g"))
    starts = F.when(F.size("_g") >= m, F.sequence(F.lit(0), F.size("_g") - m, F.lit(step // block)))
    count = lambda i: F.aggregate(F.slice("_g", i + 1, m), F.lit(0), lambda s, x: s + x)
    each = rows.select("gene", F.explode(F.transform(starts, lambda i: F.struct((i * block).alias("start"), (count(i) / width).alias("gc")))).alias("w"))
    return each.select("gene", "w.start", "w.gc").where(F.col("gc") >= least)


def translate_dna(seq: Column) -> Column:
    """Codons from the first base; unknown ones are X; ends before a stop."""
    table = F.create_map(*(F.lit(x) for pair in CODONS.items() for x in pair))
    codons = F.regexp_extract_all(F.upper(seq), F.lit("(?s).{3}"), F.lit(0))
    return F.substring_index(F.array_join(F.transform(codons, lambda c: F.coalesce(table[c], F.lit("X"))), ""), "*", 1)


def parse_protein_change(change: Column) -> Column:
    """p.V600E -> (599, E); null when short or without digits."""
    digits = F.regexp_replace(F.substring(change, F.lit(3), F.length(change) - 3), "[^0-9]", "")
    return F.when((F.length(change) >= 4) & (digits != ""), F.struct((digits.cast("int") - 1).alias("position"), F.right(change, F.lit(1)).alias("aa")))


def binding_score(peptide: Column) -> Column:
    """Anchor preferences at 0, 1 and min(8, n - 1), less 0.1 for each charged residue of the core; over 2.6, in 0..1."""
    anchors = (ANCHORS[0], ANCHORS[1], ANCHORS[8])
    n = F.length(peptide)
    total = F.lit(0.0)
    for place, prefer in zip((F.lit(1), F.lit(2), F.least(F.lit(9), n)), anchors, strict=True):
        total += F.coalesce(F.create_map(*(F.lit(x) for p in prefer.items() for x in p))[F.substring(peptide, place, F.lit(1))], F.lit(0.1))
    core = F.substring(peptide, F.lit(3), n - 4)
    charged = F.length(core) - F.length(F.regexp_replace(core, "[DEKR]", ""))
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (total - 0.1 * charged) / 2.6)), 4)


def mutant_peptides(variants: DataFrame, proteins: DataFrame, lengths: tuple[int, ...] = (8, 9, 10, 11)) -> DataFrame:
    """All windows over the changed residue, without those equal to the wild type: (gene, change, length, start, wt, mut).

    ``variants`` has gene and change; genes without a protein give nothing.
    """
    # Exploded, so that the test for null isn't pushed below, where it would make each change several times over.
    told = variants.select("gene", "change", F.explode(F.array(parse_protein_change(F.col("change")))).alias("_p")).where("_p IS NOT NULL")
    rows = told.join(proteins, "gene")
    pos, n = F.col("_p.position"), F.length("seq")
    # Only the part of the protein that a window can reach travels on.
    reach = max(lengths) - 1
    base = F.greatest(F.lit(0), pos - reach)
    rows = rows.where((pos >= 0) & (pos < n)).select("gene", "change", pos.alias("pos"), F.col("_p.aa").alias("aa"), n.alias("n"), base.alias("base"), F.substring("seq", base + 1, pos - base + reach + 1).alias("seq"))
    pos, n, at = F.col("pos"), F.col("n"), F.col("pos") - F.col("base")
    rows = rows.withColumn("_m", F.concat(F.substring("seq", F.lit(1), at), F.col("aa"), F.substring("seq", at + 2, F.lit(reach))))
    rows = rows.withColumn("length", F.explode(F.array(*map(F.lit, lengths))))
    lo, hi = F.greatest(F.lit(0), pos - F.col("length") + 1), F.least(pos, n - F.col("length"))
    rows = rows.withColumn("start", F.explode(F.when(lo <= hi, F.sequence(lo, hi))))
    cut = lambda c: F.substring(F.col(c), F.col("start") - F.col("base") + 1, F.col("length"))
    return rows.select("gene", "change", "length", "start", cut("seq").alias("wt"), cut("_m").alias("mut")).where("wt <> mut")


def neoantigens(variants: DataFrame, proteins: DataFrame, least: float = 0.5) -> DataFrame:
    """Missense variants to scored peptides with a priority."""
    missense = variants.where("variant_class = 'Missense_Mutation'").select("gene", "change").distinct()
    scored = mutant_peptides(missense, proteins).withColumn("score", binding_score(F.col("mut"))).where(F.col("score") >= least)
    return scored.withColumn("priority", priority(F.col("score")))


def neoantigen_summary(candidates: DataFrame) -> DataFrame:
    best = F.max(F.struct("score", "mut"))
    return candidates.groupBy("gene").agg(F.count(F.lit(1)).alias("n"), best["score"].alias("best_score"), best["mut"].alias("best_peptide"))


#: Letters of sequences that a task looks at together.
LETTERS = 1_000_000
_COMPLEMENT = np.full(128, ord("N"), np.uint32)
_COMPLEMENT[[*map(ord, "ACGT")]] = [*map(ord, "TGCA")]


def _complement(codes: np.ndarray) -> np.ndarray:
    return _COMPLEMENT[np.where(codes < 128, codes, 0)]


def _scores(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``on_target`` and ``off_target`` of the rows of a matrix, 20 letters each: the same sums in the same order."""
    gc = ((m == ord("G")) | (m == ord("C"))).sum(1) / 20
    on = np.full(len(m), 0.5)
    for place, w in POSITION_WEIGHTS.items():
        on += np.select([m[:, place] == ord(x) for x in w], [*w.values()], 0.0)
    on += np.select([(gc >= 0.4) & (gc <= 0.7), (gc < 0.3) | (gc > 0.8)], [0.15, -0.2], 0.0)
    t = m == ord("T")
    on -= np.where((t[:, :-3] & t[:, 1:-2] & t[:, 2:-1] & t[:, 3:]).any(1), 0.3, 0.0)
    on -= 0.2 * (m[:, 8:] == _complement(m[:, :7:-1])).sum(1) / 12
    wide = m.astype(np.int64)
    trimers = np.sort(wide[:, :-2] << 42 | wide[:, 1:-1] << 21 | wide[:, 2:], axis=1)
    few = ((trimers[:, 1:] != trimers[:, :-1]).sum(1) + 1) / 18 < 0.5
    return np.clip(on, 0, 1), np.clip(0.3 + np.abs(gc - 0.41) * 0.5 + np.where(few, 0.25, 0.0), 0, 1)


def _sites(genes: pa.Array, texts: list[str], scored: bool) -> Iterator[pa.RecordBatch]:
    """Guides of some sequences, a batch per strand: places of GG, and of CC for the other strand."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    ends = np.cumsum([len(x) for x in texts])
    for strand, letter in (("+", "G"), ("-", "C")):
        hit = codes == ord(letter)
        at = np.flatnonzero(hit[:-1] & hit[1:])
        row = np.searchsorted(ends, at, side="right")
        start, end = np.concatenate([[0], ends])[row], ends[row]
        inside = (at + 2 <= end) & (at - start >= 21 if strand == "+" else at + 23 <= end)
        at, row, start = at[inside], row[inside], start[inside]
        first = at - 21 if strand == "+" else at + 3
        m = codes[first[:, None] + np.arange(20)]
        m = m if strand == "+" else _complement(m[:, ::-1])
        known = (m != ord("N")).all(1)
        m, place = m[known], (first + 20 if strand == "+" else first)[known] - start[known]
        text = np.ascontiguousarray(m, "<u4").tobytes().decode("utf-32-le")
        columns = {"gene": genes.take(pa.array(row[known])), "strand": pa.array([strand] * len(m), pa.string()), "position": pa.array(place, pa.int32()), "spacer": pa.array([text[i : i + 20] for i in range(0, len(text), 20)], pa.string())}
        if scored:
            columns |= {n: pa.array(x) for n, x in zip(("on_target", "off_target"), _scores(m), strict=True)}
        yield pa.RecordBatch.from_pydict(columns)


def _scanned(df: DataFrame, scored: bool) -> DataFrame:
    rows = df.select("gene", F.upper("seq").alias("s")).where("s IS NOT NULL")
    kind = T.StructType([rows.schema["gene"]]).add("strand", "string").add("position", "integer").add("spacer", "string")
    kind = kind.add("on_target", "double").add("off_target", "double") if scored else kind

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, low, held = batch["s"].to_pylist(), 0, 0
            for i, text in enumerate(texts):
                held += len(text)
                if held >= LETTERS or i + 1 == len(texts):
                    yield from _sites(batch["gene"][low : i + 1], texts[low : i + 1], scored)
                    low, held = i + 1, 0

    return rows.mapInArrow(run, kind)


def guides(df: DataFrame) -> DataFrame:
    """20-base spacers before an NGG on both strands, without N: (gene, strand, position, spacer)."""
    return _scanned(df, False)


def on_target(spacer: Column) -> Column:
    """0.5, base preferences at 0, 1 and 19, GC content, a T run and self-complementarity; 0..1; 0 unless 20 bases."""
    gc = gc_content(spacer)
    total = F.lit(0.5)
    for place, w in POSITION_WEIGHTS.items():
        total += F.coalesce(F.create_map(*(F.lit(x) for p in w.items() for x in p))[F.substring(spacer, place + 1, 1)], F.lit(0.0))
    total += F.when((gc >= 0.4) & (gc <= 0.7), 0.15).when((gc < 0.3) | (gc > 0.8), -0.2).otherwise(0.0)
    total -= F.when(spacer.rlike("T{4,}"), 0.3).otherwise(0.0)
    end, partner = F.substring(spacer, 9, 12), reverse_complement(F.substring(spacer, 9, 12))
    same = F.aggregate(F.zip_with(F.split(end, ""), F.split(partner, ""), lambda a, b: (a == b).cast("int")), F.lit(0), lambda s, x: s + x)
    total -= 0.2 * same / 12
    return F.when(F.length(spacer) == 20, F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))).otherwise(0.0)


def off_target(spacer: Column) -> Column:
    n = F.length(spacer)
    trimers = F.size(F.array_distinct(F.regexp_extract_all(spacer, F.lit("(?=(.{3}))"), F.lit(1))))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.3 + F.abs(gc_content(spacer) - 0.41) * 0.5 + F.when(trimers / (n - 2) < 0.5, 0.25).otherwise(0.0)))


def _product(on: Column, off: Column) -> Column:
    """on * (1 - off) of numbers with four decimals, rounded to four: in whole numbers, so that ties round up."""
    whole = lambda c: F.round(c * 10000).cast("long")
    return F.floor((whole(on) * (10000 - whole(off)) + 5000) / 10000) / 10000.0


def guide_library(df: DataFrame, k: int = 4, least: float = 0.25) -> DataFrame:
    """Scored guides, the k best per gene."""
    rows = _scanned(df, True).withColumns({c: F.round(c, 4) for c in ("on_target", "off_target")})
    rows = rows.withColumn("score", _product(F.col("on_target"), F.col("off_target"))).where(F.col("score") >= least)
    best = W.partitionBy("gene").orderBy(F.desc("score"), "strand", "position")
    rows = rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    name = F.concat(F.lit("sg_"), F.col("gene"), F.lit("_"), F.substring(F.md5(F.col("spacer").cast("binary")), 1, 8))
    return rows.select(*rows.columns[:-1], name.alias("guide_id"), "rank")


def library_summary(library: DataFrame) -> DataFrame:
    top = F.max(F.struct("score", "guide_id"))
    return library.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("gene").alias("n_genes"), F.round(F.avg("on_target"), 4).alias("mean_on"), F.round(F.avg("score"), 4).alias("mean_score"), top["guide_id"].alias("top_guide"))


def point_mutants(df: DataFrame, mutants: int = 3) -> DataFrame:
    """Mutants with max(3, length / 100) changed bases (all, if there are fewer): (gene, mutant, seq).

    Places are drawn by a counter: draw j is hash(gene, mutant, j) modulo the length, and the first distinct ones count;
    a few more draws than changes are made, and should they repeat each other too often, the first places of the
    sequence that aren't drawn yet follow.  So a mutant costs hashes for its changes, not for its bases.  Letters are
    ASCII; sequences without letters have no mutants.
    """
    n = F.octet_length("seq")
    size = F.least(n, F.greatest(F.lit(3), F.floor(n / 100).cast("int")))
    each = df.where(n > 0).select("gene", F.col("seq").cast("binary").alias("s"), n.alias("n"), size.alias("k"), F.explode(F.sequence(F.lit(1), F.lit(mutants))).alias("mutant"))
    hashed = lambda *parts: F.md5(F.concat_ws("|", F.col("gene"), F.col("mutant").cast("string"), *parts).cast("binary"))
    number = lambda h: F.conv(F.substring(h, 1, 8), 16, 10).cast("long")
    draws = F.transform(F.sequence(F.lit(0), F.col("k") + F.floor(F.col("k") / 8).cast("int") + 15), lambda j: (number(hashed(j.cast("string"))) % F.col("n")).cast("int"))
    places = F.array_sort(F.slice(F.array_distinct(F.concat(draws, F.sequence(F.lit(0), F.col("k") - 1))), 1, F.col("k")))
    each = each.withColumn("p", places)
    # One of the three other bases: the next ones in the cycle A, C, G, T.
    step = lambda at: F.conv(F.substring(hashed(F.lit("b"), at.cast("string")), 1, 1), 16, 10).cast("int") % 3 + 1
    letter = lambda at: F.substring(F.col("s"), at + 1, F.lit(1)).cast("string")
    place = lambda b: F.when(b == "A", 1).when(b == "C", 2).when(b == "G", 3).otherwise(4)
    turned = lambda at: F.substring(F.lit("ACGTACGT"), place(letter(at)) + step(at), F.lit(1))
    # What lies between two changes is cut from the bytes as one piece.
    since = lambda i: F.when(i == 0, 0).otherwise(F.element_at("p", F.greatest(i, F.lit(1))) + 1)
    until = lambda i: F.when(i < F.col("k"), F.element_at("p", F.least(i + 1, F.col("k")))).otherwise(F.col("n"))
    piece = lambda i: F.substring(F.col("s"), since(i) + 1, until(i) - since(i)).cast("string")
    pieces = F.transform(F.sequence(F.lit(0), F.col("k")), lambda i: F.concat(piece(i), F.when(i < F.col("k"), turned(until(i))).otherwise("")))
    return each.select("gene", "mutant", F.array_join(pieces, "").alias("seq"))
