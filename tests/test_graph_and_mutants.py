"""Bit-parallel searches, sampled betweenness and mutants against brute force."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from helixframe.functions import sequence as Q
from helixframe.operators import network as G


def random_graph(spark, n, m, seed):
    r = random.Random(seed)
    edges = {tuple(sorted(r.sample(range(n), 2))) for _ in range(m)}
    near = {i: {b for a, b in edges if a == i} | {a for a, b in edges if b == i} for i in range(n)}
    both = [(f"n{a}", f"n{b}") for a, b in edges] + [(f"n{b}", f"n{a}") for a, b in edges]
    return spark.createDataFrame([(f"n{i}", "gene") for i in range(n)], "node string, type string"), spark.createDataFrame(both, "src string, dst string"), near


def walked(near, source, depth):
    dist, level = {source: 0}, [source]
    while level and (depth is None or dist[level[0]] < depth):
        level = [b for a in level for b in near[a] if b not in dist and not dist.update({b: dist[a] + 1})]
    return dist


@pytest.mark.parametrize("depth", [None, 0, 2])
def test_masks_reach_what_a_walk_reaches(spark, depth):
    nodes, edges, near = random_graph(spark, 140, 260, 1)
    got = {(r["source"], r["node"]): r["dist"] for r in G.distances(edges, nodes, depth).collect()}
    assert got == {(f"n{s}", f"n{t}"): d for s in near for t, d in walked(near, s, depth).items()}


def test_masks_are_a_row_per_64_sources(spark):
    nodes, edges, _ = random_graph(spark, 128, 400, 2)
    numbers, masks = G.reach_masks(edges, nodes)
    assert numbers.groupBy("block").count().where("count = 64").count() == 2
    pairs = G.distances(edges, nodes).count()
    assert masks.count() < pairs / 12


def test_sampled_betweenness_stays_within_its_error(spark):
    nodes, edges, _ = random_graph(spark, 120, 260, 3)
    exact = {r["node"]: r["betweenness"] for r in G.betweenness(nodes, edges).collect()}
    some = G.sampled_betweenness(nodes, edges, 1.0, first=60).collect()
    assert {r["sources"] for r in some} == {60} and len(some) == 120
    off = {r["node"]: abs(r["betweenness"] - exact[r["node"]]) for r in some}
    assert all(off[r["node"]] <= r["bound"] < 1 for r in some)
    assert sum(off[r["node"]] <= 2 * r["standard_error"] + 1e-6 for r in some) > 90  # but for neighbours of leaves
    every = G.sampled_betweenness(nodes, edges, 0.0, first=50).collect()
    assert {r["sources"] for r in every} == {120} and all(r["betweenness"] == pytest.approx(exact[r["node"]], abs=1e-6) and r["standard_error"] == r["bound"] == 0 for r in every)


def mutated(gene, m, seq):
    n = len(seq)
    k = min(n, max(3, n // 100))
    md5 = lambda *parts: hashlib.md5("|".join([gene, str(m), *parts]).encode()).hexdigest()
    places = list(dict.fromkeys([int(md5(str(j))[:8], 16) % n for j in range(k + k // 8 + 16)] + list(range(k))))[:k]
    out = list(seq)
    for p in places:
        out[p] = "ACGTACGT"[max("ACGT".find(seq[p]), 0) + int(md5("b", str(p))[0], 16) % 3 + 1] if seq[p] in "ACGT" else "ACGTACGT"[3 + int(md5("b", str(p))[0], 16) % 3 + 1]
    return "".join(out)


def test_mutants_change_the_drawn_places(spark):
    r = random.Random(4)
    rows = [(f"g{n}", "".join(r.choices("ACGT", k=n))) for n in (1, 2, 3, 4, 5, 10, 99, 300, 1234, 60_000)] + [("none", ""), ("null", None), ("odd", "NNACN")]
    got = {(x["gene"], x["mutant"]): x["seq"] for x in Q.point_mutants(spark.createDataFrame(rows, "gene string, seq string")).collect()}
    assert got == {(g, m): mutated(g, m, s) for g, s in rows if s for m in (1, 2, 3)}
    for (g, _), s in got.items():
        own = dict(rows)[g]
        assert len(s) == len(own) and sum(a != b for a, b in zip(s, own, strict=True)) == min(len(own), max(3, len(own) // 100))


def test_mutants_of_one_length_share_no_places(spark):
    df = spark.range(40).select(F.concat(F.lit("g"), "id").alias("gene"), F.repeat(F.lit("A"), 3000).alias("seq"))
    seqs = [x["seq"] for x in Q.point_mutants(df, 1).collect()]
    places = [i for s in seqs for i, c in enumerate(s) if c != "A"]
    assert len(places) == 1200 and len(set(places)) > 900 and 1300 < sum(places) / 1200 < 1700
