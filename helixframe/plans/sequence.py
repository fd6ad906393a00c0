"""Queries of sequence jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequence as Q
from .base import query

GC = "CASE WHEN length({0}) > 0 THEN CAST(length({0}) - length(regexp_replace(upper({0}), '[GC]', '', 'g')) AS DOUBLE) / length({0}) ELSE 0 END"
RC = "translate(reverse(regexp_replace(upper({0}), '[^ACGTN]', 'N', 'g')), 'ACGT', 'TGCA')"
CASE = lambda x, m, d: f"CASE {x} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in m.items()) + f" ELSE {d}::DOUBLE END"
CODON_SQL = "CASE substr(seq, 3 * i + 1, 3) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in Q.CODONS.items()) + " ELSE 'X' END"


@query("f1_gc_profile", f"SELECT gene, length(seq) AS n, round({GC.format('seq')}, 6) AS gc FROM sequences")
def f1(v):
    return v.sequences.select("gene", F.length("seq").cast("long").alias("n"), F.round(Q.gc_content(F.col("seq")), 6).alias("gc"))


@query("f2_gc_windows", f"SELECT gene, CAST(start AS INTEGER) AS start, round(gc, 6) AS gc FROM (SELECT gene, start, {GC.format('substr(seq, start + 1, 200)')} AS gc FROM (SELECT gene, seq, unnest(range(0, length(seq) - 199, 100)) AS start FROM sequences)) WHERE gc >= 0.5")
def f2(v):
    return Q.gc_windows(v.sequences, least=0.5).withColumn("gc", F.round("gc", 6))


@query("f3_reverse_complement", f"SELECT gene, md5({RC.format('seq')}) AS digest FROM sequences")
def f3(v):
    return v.sequences.select("gene", F.md5(Q.reverse_complement(F.col("seq")).cast("binary")).alias("digest"))


@query("f4_translate", f"WITH c AS (SELECT gene, i, {CODON_SQL} AS aa FROM (SELECT gene, seq, unnest(range(length(seq) // 3)) AS i FROM sequences)), p AS (SELECT gene, string_agg(aa, '' ORDER BY i) AS p FROM c GROUP BY 1) SELECT s.gene, coalesce(split_part(p, '*', 1), '') AS protein FROM sequences s LEFT JOIN p ON s.gene = p.gene")
def f4(v):
    return v.sequences.select("gene", Q.translate_dna(F.col("seq")).alias("protein"))


def changes(v):
    """Missense changes at a place of the whole protein that the document's id sets."""
    aa = F.substring(F.lit("ACDEFGHIKLMNPQRSTVWY"), (F.col("doc_id") % 20 + 1).cast("int"), F.lit(1))
    kind = F.when(F.col("doc_id") % 3 == 0, "Silent").otherwise("Missense_Mutation")
    letters = F.greatest(F.length(F.regexp_replace(F.lower("text"), "[^a-z]", "")), F.lit(1))
    place = (F.col("doc_id") * 7919 % letters + 1).cast("string")
    return v.documents.select(F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("gene"), F.concat(F.lit("p.A"), place, aa).alias("change"), kind.alias("variant_class"))


CH = "ch AS (SELECT concat('D', CAST(doc_id AS VARCHAR)) AS gene, concat('p.A', CAST(doc_id * 7919 % greatest(length(regexp_replace(lower(text), '[^a-z]', '', 'g')), 1) + 1 AS VARCHAR), substr('ACDEFGHIKLMNPQRSTVWY', CAST(doc_id % 20 + 1 AS INTEGER), 1)) AS change, CASE WHEN doc_id % 3 = 0 THEN 'Silent' ELSE 'Missense_Mutation' END AS variant_class FROM documents)"
PEP = f"""{CH}, m AS (SELECT DISTINCT ch.gene, change, seq, CAST(regexp_replace(substr(change, 3, length(change) - 3), '[^0-9]', '', 'g') AS INTEGER) - 1 AS pos, right(change, 1) AS aa FROM ch JOIN proteins p ON ch.gene = p.gene WHERE variant_class = 'Missense_Mutation'),
l AS (SELECT *, concat(substr(seq, 1, pos), aa, substr(seq, pos + 2)) AS mseq, unnest([8, 9, 10, 11]) AS len FROM m WHERE pos < length(seq)),
w AS (SELECT *, unnest(range(greatest(0, pos - len + 1), least(pos, length(seq) - len) + 1)) AS start FROM l),
pep AS (SELECT gene, change, len, start, substr(seq, start + 1, len) AS wt, substr(mseq, start + 1, len) AS mut FROM w WHERE substr(seq, start + 1, len) <> substr(mseq, start + 1, len)),
sc AS (SELECT *, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, ({CASE('substr(mut, 1, 1)', Q.ANCHORS[0], 0.1)} + {CASE('substr(mut, 2, 1)', Q.ANCHORS[1], 0.1)} + {CASE('substr(mut, least(9, length(mut)), 1)', Q.ANCHORS[8], 0.1)} - 0.1::DOUBLE * (length(mut) - 4 - length(regexp_replace(substr(mut, 3, length(mut) - 4), '[DEKR]', '', 'g')))) / 2.6::DOUBLE)), 4) AS score FROM pep)"""


@query("f5_f6_f7_f8_neoantigens", f"WITH {PEP} SELECT gene, change, len AS length, CAST(start AS INTEGER) AS start, wt, mut, score, CASE WHEN score >= 0.75 THEN 'HIGH' WHEN score >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS priority FROM sc WHERE score >= 0.5")
def f8(v):
    return Q.neoantigens(changes(v), v.proteins)


@query("a47_t3_neoantigen_summary", f"WITH {PEP} SELECT gene, count(*) AS n, max(score) AS best_score, max(struct_pack(s := score, m := mut)).m AS best_peptide FROM sc WHERE score >= 0.3 GROUP BY 1 ORDER BY 3 DESC")
def a47(v):
    return Q.neoantigen_summary(Q.neoantigens(changes(v), v.proteins, 0.3)).orderBy(F.desc("best_score"), "gene")


GUIDES = f"""st AS (SELECT gene, upper(seq) AS s, '+' AS strand FROM sequences UNION ALL SELECT gene, {RC.format('seq')}, '-' FROM sequences),
gi AS (SELECT gene, strand, s, unnest(range(20, length(s) - 2)) AS i FROM st), gd AS (SELECT gene, strand, CASE WHEN strand = '+' THEN i ELSE length(s) - i END AS position, substr(s, i - 19, 20) AS sp FROM gi WHERE substr(s, i + 2, 2) = 'GG'),
gg AS (SELECT *, {GC.format('sp')} AS gc, substr(sp, 9, 12) AS e FROM gd WHERE NOT contains(sp, 'N')),
gs AS (SELECT *, (SELECT sum(CASE WHEN substr(e, j, 1) = substr({RC.format('e')}, j, 1) THEN 1 ELSE 0 END) FROM (SELECT unnest(range(1, 13)) AS j)) AS comp FROM gg)"""


@query("f9_guide_scan", f"WITH {GUIDES} SELECT gene, strand, CAST(position AS INTEGER) AS position, sp AS spacer FROM gg")
def f9(v):
    return Q.guides(v.sequences)


W_ = " + ".join(CASE(f"substr(sp, {k + 1}, 1)", m, 0) for k, m in Q.POSITION_WEIGHTS.items())
COMP = "(" + " + ".join(f"CASE WHEN substr(sp, {8 + j}, 1) = translate(substr(sp, {21 - j}, 1), 'ACGT', 'TGCA') THEN 1 ELSE 0 END" for j in range(1, 13)) + ")"
TRI = "len(list_distinct([" + ", ".join(f"substr(sp, {i}, 3)" for i in range(1, 19)) + "]))"
LIB = f"""{GUIDES.split(', gs AS')[0].rsplit(chr(10) + 'gs AS', 1)[0].rstrip().rstrip(',')},
on1 AS (SELECT *, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.5::DOUBLE + {W_} + CASE WHEN gc >= 0.4 AND gc <= 0.7 THEN 0.15::DOUBLE WHEN gc < 0.3 OR gc > 0.8 THEN -0.2::DOUBLE ELSE 0 END - CASE WHEN contains(sp, 'TTTT') THEN 0.3::DOUBLE ELSE 0 END - 0.2::DOUBLE * {COMP} / 12)), 4) AS on_target, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.3::DOUBLE + abs(gc - 0.41::DOUBLE) * 0.5::DOUBLE + CASE WHEN {TRI} / 18.0::DOUBLE < 0.5 THEN 0.25::DOUBLE ELSE 0 END)), 4) AS off_target FROM gg),
on2 AS (SELECT *, ((CAST(round(on_target * 10000) AS BIGINT) * (10000 - CAST(round(off_target * 10000) AS BIGINT)) + 5000) // 10000) / 10000.0::DOUBLE AS score, concat('sg_', gene, '_', substr(md5(sp), 1, 8)) AS guide_id FROM on1),
lib AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY score DESC, strand, position) AS rank FROM on2 WHERE score >= 0.25) WHERE rank <= 4)"""


@query("f10_f11_w12_guide_library", f"WITH {LIB} SELECT gene, strand, CAST(position AS INTEGER) AS position, sp AS spacer, on_target, off_target, score, guide_id, rank FROM lib")
def f11(v):
    return Q.guide_library(v.sequences)


@query("a48_library_summary", f"WITH {LIB} SELECT count(*) AS n, count(DISTINCT gene) AS n_genes, round(avg(on_target), 4) AS mean_on, round(avg(score), 4) AS mean_score, max(struct_pack(s := score, g := guide_id)).g AS top_guide FROM lib")
def a48(v):
    return Q.library_summary(Q.guide_library(v.sequences))


@query("f12_point_mutants", "WITH s AS (SELECT gene, seq, length(seq) AS n, least(length(seq), greatest(3, length(seq) // 100)) AS k, m FROM sequences, (SELECT unnest(range(1, 4)) AS m) WHERE seq <> ''), dr AS (SELECT gene, m, n, k, j, ('0x' || substr(md5(concat(gene, '|', CAST(m AS VARCHAR), '|', CAST(j AS VARCHAR))), 1, 8))::BIGINT % n AS p FROM (SELECT *, unnest(range(0, k + k // 8 + 16)) AS j FROM s) UNION ALL SELECT gene, m, n, k, 1000000000 + i, i FROM (SELECT *, unnest(range(0, k)) AS i FROM s)), fi AS (SELECT gene, m, k, p, min(j) AS j FROM dr GROUP BY ALL), hit AS (SELECT gene, m, p FROM (SELECT *, row_number() OVER (PARTITION BY gene, m ORDER BY j) AS r FROM fi) WHERE r <= k), e AS (SELECT gene, m, unnest(string_split(seq, '')) AS b, unnest(range(0, n)) AS i FROM s) SELECT e.gene, CAST(e.m AS INTEGER) AS mutant, string_agg(CASE WHEN p IS NULL THEN b ELSE substr('ACGTACGT', CAST(strpos('ACGT', b) + ('0x' || substr(md5(concat(e.gene, '|', CAST(e.m AS VARCHAR), '|b|', CAST(i AS VARCHAR))), 1, 1))::BIGINT % 3 + 1 AS INTEGER), 1) END, '' ORDER BY i) AS seq FROM e LEFT JOIN hit ON e.gene = hit.gene AND e.m = hit.m AND e.i = hit.p GROUP BY 1, 2")
def f12(v):
    return Q.point_mutants(v.sequences)


@query("s14_fasta", "SELECT concat('D', CAST(doc_id AS VARCHAR)) AS gene, regexp_replace(upper(regexp_replace(concat('>D', CAST(doc_id AS VARCHAR), chr(10), text), '^>[^' || chr(10) || ']*' || chr(10), '')), '[^ACGT]', '', 'g') AS seq FROM documents")
def s14(v):
    from ..sources.readers import read_fasta
    from .ingest import _path

    path = _path(v, "fasta")
    letters = F.regexp_replace("text", "[^A-Za-z\n]", "")
    v.documents.select(F.concat(F.lit(">D"), F.col("doc_id").cast("string"), F.lit("\n"), letters)).write.text(path)
    return read_fasta(v.spark, path)
