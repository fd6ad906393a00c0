"""Queries of the drug-gene-pathway graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import network as G
from .base import query

GRAPH = "gp AS (SELECT * FROM gene_pathway WHERE gene IN (SELECT gene FROM drug_gene)), nodes AS (SELECT DISTINCT drug AS node, 'drug' AS type FROM drug_gene UNION SELECT DISTINCT gene, 'gene' FROM drug_gene UNION SELECT DISTINCT pathway, 'pathway' FROM gp), o AS (SELECT drug AS src, gene AS dst FROM drug_gene UNION SELECT gene, pathway FROM gp), edges AS (SELECT src, dst FROM o UNION SELECT dst, src FROM o)"


def graph(v):
    return G.tripartite(v.drug_gene, v.gene_pathway)


@query("g1_tripartite", f"WITH {GRAPH} SELECT src, dst FROM edges")
def g1(v):
    return graph(v)[1]


@query("g2_degree_centrality", f"WITH {GRAPH}, d AS (SELECT src, count(*) AS degree FROM edges GROUP BY 1) SELECT node, type, coalesce(degree, 0) AS degree, round(CAST(coalesce(degree, 0) AS DOUBLE) / ((SELECT count(*) FROM nodes) - 1), 6) AS centrality FROM nodes LEFT JOIN d ON node = src")
def g2(v):
    return G.degree_centrality(*graph(v))


#: More levels than any of the given graphs has.
DEPTH = 12


def levels(sources: str) -> str:
    out = f"l0 AS MATERIALIZED (SELECT node AS source, node, 0 AS dist, 1.0::DOUBLE AS sigma FROM nodes WHERE {sources})"
    for _k in range(1, DEPTH + 1):
        _seen = " UNION ALL ".join(f"SELECT source, node FROM l{j}" for j in range(_k))
        out += f", s{_k} AS ({_seen}), l{_k} AS MATERIALIZED (SELECT l.source, e.dst AS node, {_k} AS dist, sum(sigma) AS sigma FROM l{_k - 1} l JOIN edges e ON l.node = e.src LEFT JOIN s{_k} s ON s.source = l.source AND s.node = e.dst WHERE s.node IS NULL GROUP BY 1, 2)"
    return out


BFS, EVERY = levels("type = 'gene'"), levels("true")
ALL = " UNION ALL ".join(f"SELECT * FROM l{j}" for j in range(DEPTH + 1))


@query("g3_shortest_paths", f"WITH {GRAPH}, {BFS} SELECT source, dist, count(*) AS n, round(sum(sigma), 2) AS paths FROM ({ALL}) GROUP BY 1, 2")
def g3(v):
    nodes, edges = graph(v)
    paths = G.shortest_paths(edges, nodes.where("type = 'gene'"))
    return paths.groupBy("source", "dist").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("sigma"), 2).alias("paths"))


#: Shares that flow back along shortest paths, level by level.
BACK = f"d{DEPTH} AS MATERIALIZED (SELECT source, node, 0.0::DOUBLE AS delta FROM l{DEPTH})"
for _k in range(DEPTH, 0, -1):
    BACK += f", d{_k - 1} AS MATERIALIZED (SELECT a.source, a.node, a.sigma * coalesce(sum((1 + d.delta) / w.sigma), 0) AS delta FROM l{_k - 1} a LEFT JOIN (l{_k} w JOIN d{_k} d ON d.source = w.source AND d.node = w.node JOIN edges e ON e.dst = w.node) ON w.source = a.source AND e.src = a.node GROUP BY a.source, a.node, a.sigma)"
FLOW = " UNION ALL ".join(f"SELECT node, delta FROM d{j}" for j in range(1, DEPTH + 1))


@query("g3_distances", f"WITH {GRAPH}, {EVERY} SELECT source, dist, count(*) AS n FROM ({ALL}) GROUP BY 1, 2")
def g3_distances(v):
    nodes, edges = graph(v)
    return G.distance_counts(nodes, edges)


@query("g4_betweenness", f"WITH {GRAPH}, {EVERY}, {BACK}, t AS (SELECT node, sum(delta) AS t FROM ({FLOW}) GROUP BY 1), n AS (SELECT count(*) AS n FROM nodes) SELECT nodes.node, type, round(coalesce(t, 0) / ((n - 1) * (n - 2)), 6) AS betweenness FROM nodes CROSS JOIN n LEFT JOIN t ON nodes.node = t.node")
def g4(v):
    nodes, edges = graph(v)
    return G.betweenness(nodes, edges)


@query("g4_sampled_betweenness")
def g4_sampled(v):
    """Estimates that are off by 0.1 at most, with a chance of 5 %."""
    nodes, edges = graph(v)
    out = G.sampled_betweenness(nodes, edges, 0.1)
    return out.withColumns({c: F.round(c, 6) for c in ("betweenness", "standard_error", "bound")})


@query("g5_combination_targets", f"WITH {GRAPH}, {BFS}, near AS (SELECT a.* FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2) a JOIN nodes n ON a.node = n.node AND type = 'gene'), dr AS (SELECT src, string_agg(dst, ',' ORDER BY dst) AS drugs FROM edges JOIN nodes ON dst = node AND type = 'drug' GROUP BY 1), pa AS (SELECT src, dst FROM edges JOIN nodes ON dst = node AND type = 'pathway'), sh AS (SELECT x.source, x.node, string_agg(p.dst, ',' ORDER BY p.dst) AS shared FROM near x JOIN pa p ON p.src = x.node JOIN pa q ON q.src = x.source AND q.dst = p.dst GROUP BY 1, 2) SELECT near.source, near.node, near.dist, coalesce(shared, '') AS shared, md5(drugs) AS drugs FROM near JOIN dr ON near.node = dr.src LEFT JOIN sh ON near.source = sh.source AND near.node = sh.node")
def g5(v):
    nodes, edges = graph(v)
    out = G.combination_targets(nodes, edges, nodes.where("type = 'gene'"))
    return out.select("source", "node", "dist", F.array_join("shared", ",").alias("shared"), F.md5(F.array_join("drugs", ",").cast("binary")).alias("drugs"))


@query("g7_strategic_score", f"WITH {GRAPH}, n AS (SELECT src, count(*) FILTER (type = 'drug') AS d, count(*) FILTER (type = 'pathway') AS p, count(*) AS n FROM edges JOIN nodes ON dst = node GROUP BY 1) SELECT node, round(CAST(0.4 * least(1.0, 0.2 * d) + 0.3 * least(1.0, 0.15 * p) + 0.3 * least(1.0, 0.1 * n) AS DOUBLE), 4) AS score FROM nodes JOIN n ON node = src WHERE type = 'gene'")
def g7(v):
    return G.strategic_score(*graph(v))


FEAT = "dg AS (SELECT node, type, CAST(count(src) AS DOUBLE) AS degree FROM nodes LEFT JOIN edges ON node = src GROUP BY 1, 2), h0 AS (SELECT node, 0 AS dim, CASE WHEN type = 'drug' THEN 1.0::DOUBLE ELSE 0 END AS h FROM nodes UNION ALL SELECT node, 1, CASE WHEN type = 'gene' THEN 1.0::DOUBLE ELSE 0 END FROM nodes UNION ALL SELECT node, 2, CASE WHEN type = 'pathway' THEN 1.0::DOUBLE ELSE 0 END FROM nodes UNION ALL SELECT node, 3, degree / (SELECT max(degree) FROM dg) FROM dg), lo AS (SELECT src, dst FROM edges UNION ALL SELECT node, node FROM nodes), de AS (SELECT src, count(*) AS d FROM lo GROUP BY 1), nm AS (SELECT lo.src, lo.dst, 1 / sqrt(CAST(a.d AS DOUBLE) * b.d) AS w FROM lo JOIN de a ON a.src = lo.src JOIN de b ON b.src = lo.dst), h1 AS (SELECT dst AS node, dim, sum(w * h) AS h FROM nm JOIN h0 ON h0.node = nm.src GROUP BY 1, 2), h2 AS (SELECT dst AS node, dim, sum(w * h) AS h FROM nm JOIN h1 ON h1.node = nm.src GROUP BY 1, 2)"


@query("g8_g9_propagation", f"WITH {GRAPH}, {FEAT} SELECT node, dim, round(h, 5) AS h FROM h2")
def g9(v):
    nodes, edges = graph(v)
    return G.propagate(G.node_features(nodes, edges), nodes, edges).withColumn("h", F.round("h", 5))


@query("g10_node_scores", f"WITH {GRAPH}, {FEAT}, n AS (SELECT h2.node, type, sqrt(sum(h * h)) AS norm FROM h2 JOIN nodes USING (node) GROUP BY 1, 2), sc AS (SELECT node, type, round(norm / max(norm) OVER (PARTITION BY type), 4) AS score FROM n), nb AS (SELECT src, count(*) AS degree, count(*) FILTER (type = 'gene') AS n_genes FROM edges JOIN nodes ON dst = node GROUP BY 1) SELECT node, type, score, row_number() OVER (PARTITION BY type ORDER BY score DESC, node) AS rank, coalesce(degree, 0) AS degree, coalesce(n_genes, 0) AS n_genes FROM sc LEFT JOIN nb ON src = node")
def g10(v):
    nodes, edges = graph(v)
    return G.node_scores(G.propagate(G.node_features(nodes, edges), nodes, edges), nodes, edges)


@query("p17_g10_pair_scores", f"WITH {GRAPH}, {FEAT}, nn AS (SELECT node, sqrt(sum(h * h)) AS n FROM h2 GROUP BY 1), u AS (SELECT h2.node, dim, h / n AS u FROM h2 JOIN nn USING (node)) SELECT a.node AS a, b.node AS b, round(1 / (1 + exp(-sum(a.u * b.u))), 4) AS score FROM drug_gene p JOIN u a ON a.node = p.drug JOIN u b ON b.node = p.gene AND a.dim = b.dim GROUP BY 1, 2")
def p17(v):
    nodes, edges = graph(v)
    features = G.propagate(G.node_features(nodes, edges), nodes, edges)
    return G.pair_scores(features, v.drug_gene.select(F.col("drug").alias("a"), F.col("gene").alias("b")))
