"""Line runs, whitening and source divergence against brute force, with nulls, repeats, clashing columns and empty tables."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from helixframe.llm import _io, divergence, line_runs, ngram_join, whitening
from helixframe.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
BLANKS = " \t\n\x0b\x0c\r"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


@pytest.mark.parametrize("name", ["op11_line_dedup", "op13_source_divergence"])
def test_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df = QUERIES[name](spark, SF)
    cursor = con.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(tuple(r) for r in df.select(*names).collect()) == sorted(cursor.fetchall())


def shared_lines(rows, chars, documents):
    held = defaultdict(set)
    keys = lambda t: [lower(x.strip(BLANKS)) for x in (t or "").split("\n")]
    for i, t in rows:
        if i is not None:
            for k in keys(t):
                if len(k) >= chars:
                    held[k].add(i)
    top = {k: max(v) for k, v in held.items() if len(v) >= documents}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x, k in zip(lines, keys(t), strict=True) if i is None or k not in top or top[k] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def line_documents(seed):
    r = random.Random(seed)
    pool = [f"  Line {i} É{'x' * r.randint(25, 60)} end\x0b" for i in range(30)]
    rows = [(i, "\n".join(r.choice([str.lower, str.upper, str])(r.choice(pool)) if r.random() < 0.6 else f"own {i} {r.random()}" for _ in range(r.randint(1, 9)))) for i in range(80)]
    hot = "  THE LINE THAT A THIRD OF ALL DOCUMENTS HAVE, again and again  "
    rows += [(i, f"{hot}\nb\n{hot.lower()}") for i in range(100, 160)]
    rows += [(None, hot), (None, None), (7, pool[0]), (7, pool[0]), (200, None), (201, ""), (202, "\n\n"), (203, (hot + "\n") * 5000)]
    return [(i, None if t is None else lower(t) if i == 150 else t) for i, t in rows]


@pytest.mark.parametrize("batches", [1, 5])
def test_line_runs(spark, batches):
    rows = line_documents(batches)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"line": F.lit("clash"), "_key": F.lit(1), "_text": F.lit(2), "n_lines": F.lit(3), "top": F.lit(4)}).repartition(3)
    out = line_runs.without_shared_lines(docs, batches=batches)
    assert sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in out.collect()), key=str) == shared_lines(rows, 40, 5)


def test_line_runs_other_keys_and_thresholds(spark):
    rows = [(f"d{i}", t) for i, (_, t) in enumerate(line_documents(3))]
    out = line_runs.without_shared_lines(spark.createDataFrame(rows, "name string, body string"), "name", "body", chars=30, documents=2)
    assert sorted(((r["name"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in out.collect()), key=str) == shared_lines(rows, 30, 2)
    assert line_runs.without_shared_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_runs_settle_in_any_order(spark):
    """Settled lines don't enter a run again, runs stay few, and the order of batches doesn't matter."""
    pairs = [(bytes([k]) * 16, d) for k in range(40) for d in range(60) if (k * 7 + d * 11) % 13 < k % 12]
    for first, order in ((False, range(6)), (True, range(5, -1, -1))):
        runs = line_runs.LineRuns(spark, 5, buckets=3)
        added = []
        for b in order:
            batch = [(k, d) for k, d in pairs if d // 10 == b]
            df = spark.createDataFrame(batch, "line binary, doc long")
            own = df.groupBy("line").agg(F.count("doc").alias("n"), F.max("doc").alias("top"))
            added.append((own.count(), runs.unsettled(own).count()))
            runs.add(df)
            assert len(runs.runs) <= 3
        if first:  # the largest documents came first
            assert sum(b for _, b in added) < sum(a for a, _ in added)
        held = defaultdict(set)
        for k, d in pairs:
            held[k].add(d)
        assert {(bytes(r["line"]), r["top"]) for r in runs.frequent().collect()} == {(k, max(v)) for k, v in held.items() if len(v) >= 5}


def test_merge_joins_of_runs_do_not_shuffle_them(spark):
    runs = line_runs.LineRuns(spark, 2, buckets=4)
    rows = [(bytes([k]) * 16, d) for k in range(50) for d in range(3)]
    runs.add(spark.createDataFrame(rows, "line binary, doc long"))
    own = spark.createDataFrame(rows, "line binary, doc long").groupBy("line").agg(F.count("doc").alias("n"), F.max("doc").alias("top"))
    plan = runs.unsettled(own)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1 and "Bucketed: true" in plan
    assert runs.unsettled(own).count() == 0


def covariance(x):
    c = x - x.mean(0)
    return c.T @ c / len(x)


def test_jacobi_davidson_finds_the_largest_pairs():
    rng = np.random.default_rng(5)
    for dims, wanted, spread in ((40, 5, 1.0), (120, 12, 0.01), (7, 20, 1.0), (60, 8, 0.0)):
        base = rng.standard_normal((300, dims)) * np.sqrt(1 + spread * np.arange(dims))
        v = covariance(base) if spread else np.diag(np.repeat([4.0, 2.0, 1.0], 20))  # equal eigenvalues
        values, vectors = whitening.jacobi_davidson(lambda u, v=v: v @ u, dims, wanted)
        assert np.allclose(values, np.linalg.eigvalsh(v)[::-1][:wanted], rtol=1e-12)
        assert np.abs(v @ vectors - vectors * values).max() < 1e-12 * values[0] and np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12


def test_minres_solves_indefinite_systems():
    rng = np.random.default_rng(6)
    a = rng.standard_normal((30, 30))
    a = a + a.T
    b = rng.standard_normal((30, 4))
    assert np.allclose(whitening.minres(lambda x: a @ x, b, 200, 1e-13), np.linalg.solve(a, b), atol=1e-8)
    assert not whitening.minres(lambda x: a @ x, np.zeros((30, 2)), 5, 0.1).any()


def test_whitening(spark):
    rng = np.random.default_rng(7)
    base = (rng.standard_normal((200, 6)) * [1, 0.5, 0.3, 2, 0.1, 0.7]).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    extra = [(900, None), (901, [None] + [0.0] * 5), (902, [float("nan")] + [0.0] * 5), (903, [float("inf")] + [0.0] * 5), (None, rows[0][1]), (3, rows[3][1]), (3, rows[3][1])]
    df = spark.createDataFrame(rows + extra, "vec_id long, embedding array<float>").withColumns({"_x": F.lit(0), "n": F.lit(1), "component": F.lit(2)}).repartition(5)
    out = whitening.whitened(df, components=4).collect()
    kept = np.array([v for _, v in rows + [extra[4], extra[5], extra[6]]])
    x = np.floor(64 * kept).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    values, vectors = np.linalg.eigh(covariance(x - 1_000_000.0))
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(out) == 4 * n and {r["component"] for r in out} == {1, 2, 3, 4} and {r["n"] for r in out} == {n}
    w = {(r["vec_id"], r["component"]): r["whitened"] for r in out if r["vec_id"] not in (None, 3)}
    expected = ((n * x - s) / n) @ vectors / np.sqrt(values)
    for c in range(4):
        own = np.array([w[i, c + 1] for i in range(200) if i != 3])
        other = np.delete(expected[:200, c], 3)
        assert np.allclose(own, other if own[0] * other[0] > 0 else -other, atol=1e-9)
    assert all(r["deviation"] == int(((n * x[r["vec_id"]] - s) ** 2).sum()) for r in out if r["vec_id"] is not None)
    assert all(abs(r["explained"] - values[r["component"] - 1] / values.sum()) < 1e-12 for r in out)
    assert {r["identity_error"] for r in out} == {out[0]["identity_error"]} and out[0]["identity_error"] < 1e-10


def test_whitening_without_variance(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(i, [0.5, 0.25]) for i in range(9)], [(1, None)]):
        assert whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).count() == 0
    line = whitening.whitened(spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(9)], "vec_id long, embedding array<double>")).collect()
    assert len(line) == 9 and {r["component"] for r in line} == {1} and all(abs(r["explained"] - 1) < 1e-12 for r in line)
    with pytest.raises(ValueError):
        whitening.whitened(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>"))
    with pytest.raises(ValueError):
        whitening.whitened(spark.createDataFrame([(1, [1e12]), (2, [1.0])], "vec_id long, embedding array<double>"))


def test_sums_in_groups_of_tasks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "PARTIALS", 3)
    x = np.random.default_rng(8).standard_normal((50, 4))
    blocks = spark.createDataFrame([(bytearray(r.tobytes()),) for r in x], "block binary").repartition(11)
    assert np.allclose(whitening.distributed_sum(blocks, (4,), lambda raw: raw), x.sum(0))


def divergence_by_hand(rows, documents, top):
    docs = [(a or "", b or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t or ""))) for a, b, t in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        held = Counter(t for d in own for t in set(d[2]))
        kept = sorted(t for t, n in held.items() if n >= documents)
        counts = {s: Counter(t for d in own if d[1] == s for t in d[2] if held[t] >= documents) for s in {d[1] for d in own}}
        share = lambda c, n: 1 + 10**9 * (c + 2) // (n + 2 * len(kept))  # noqa: B023, E731
        p = {s: {t: share(c[t], c.total()) for t in kept} for s, c in counts.items()}
        every = sum(counts.values(), Counter())
        q = {t: share(every[t], every.total()) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in counts:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in counts if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, r + 1) for r, (i, v) in enumerate(items[:most])]
    return sorted(out)


def test_source_divergence(spark):
    r = random.Random(9)
    words = ["a", "ab", "abc", "abcdefghi", "abcdefghij", "É", "Éa", "ÉaÉaÉaÉa", "zz", "日本語", "don"] + [f"w{'xyz'[i % 3]}{'k' * (i % 11)}" for i in range(20)]
    rows = [(r.choice(["en", "de", None, ""]), r.choice(["s0"] * 5 + ["s1", "s2", None, "日"]), " ".join(r.choice([str, str.upper, str])(r.choice(words)) + r.choice([",", "1", "'t", "\n"]) for _ in range(r.randint(0, 12)))) for _ in range(240)]
    rows += [("en", "empty", None), ("xx", "only", "rare words"), ("xx", "other", None), ("yy", "alone", "b " * 30_000), ("en", "s0", "x" * 50_000)] + rows[:3] * 4
    docs = spark.createDataFrame(rows, "lang string, source string, text string").withColumns({"terms": F.lit(1), "prefix": F.lit(2), "at": F.lit(3), "n": F.lit(4)}).repartition(4)
    got = divergence.source_divergence(docs, documents=4, top=3)
    assert sorted(tuple(x) for x in got.select("lang", "source", "part", "item", "value", "rank").collect()) == divergence_by_hand(rows, 4, 3)
    assert divergence.source_divergence(docs.limit(0)).count() == 0


def test_prefix_levels_discard(spark, monkeypatch):
    """Each level counts distinct documents and goes on only with prefixes that are in enough of them."""
    seen = []
    real = divergence._documents
    monkeypatch.setattr(divergence, "_documents", lambda b, size, parents: seen.append((size, out := real(b, size, parents))) or out)
    rows = [("en", "s", t) for t in ["abcd abce", "abcd abcf", "abcd zzzz", "abx zzzy", "abcdef", "abcdef abcdeg"]]
    blocks = _io.written(divergence.term_blocks(spark.createDataFrame(rows, "lang string, source string, text string")), "blocks")
    kept = {r["prefix"].decode(): r["docs"] for r in divergence.kept_terms(blocks, 3, (2, 4)).collect()}
    assert kept == {"abcd": 3}
    levels = {size: {bytes(r["prefix"]).decode(): r["docs"] for r in df.collect()} for size, df in seen if size == 2}
    assert levels[2] == {"ab": 6, "zz": 2}


def test_tasks_decode_and_join_few_blocks_at_once(spark, monkeypatch):
    """Spark decodes a row group of large rows whole, and a task joins the blocks of an Arrow batch."""
    rows = [(f"l{i:02}", "s", f"alpha beta gamma{i}") for i in range(divergence.GROUP_ROWS + 24)]
    seen, real = [], divergence.kept_terms
    monkeypatch.setattr(divergence, "kept_terms", lambda blocks, *a: seen.append([pq.ParquetFile(f.removeprefix("file:")).metadata for f in blocks.inputFiles()]) or real(blocks, *a))
    divergence.source_divergence(spark.createDataFrame(rows, "lang string, source string, text string").coalesce(1))
    sizes = [m.row_group(i).num_rows for m in seen[0] for i in range(m.num_row_groups)]
    assert sum(sizes) == len(rows) and max(sizes) <= divergence.GROUP_ROWS
    blocks = divergence.term_blocks(spark.createDataFrame([("en", "s", f"alpha beta gamma{i}") for i in range(9)], "lang string, source string, text string").repartition(9))
    batch = blocks.toArrow().combine_chunks().to_batches()[0]
    whole, parts = list(divergence._held(iter([batch]))), list(divergence._held(iter([batch]), 6))
    assert len(whole) == 1 and len(parts) > 1 and all(len(h.term) <= max(6, *batch["term"].value_lengths().to_pylist()) for _, h in parts)
    told = lambda held: sorted(h.terms[int(t)].as_py() for _, h in held for t in h.term)
    assert told(parts) == told(whole)


def test_shares_are_exact():
    counts = np.array([0, 1, 10**12, 4 * 10**15])
    total = 8 * 10**15
    assert divergence.shares(counts, total, 7).tolist() == [1 + 10**9 * (int(c) + 2) // (total + 14) for c in counts]


@pytest.mark.parametrize("repeats", [False, True])
def test_rows_without_a_key_stay_in_the_join(spark, repeats):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (None, "x y z w v u"), (3, None)] + ([(1, "a b c d e f")] if repeats else [])
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), k=3, percent=90).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == sorted(
        [(1, 4, 1), (2, 4, 1), (None, 4, None), (3, 0, 3)] + ([(1, 4, 1)] if repeats else []), key=str
    )
