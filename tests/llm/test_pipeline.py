"""The pipeline and each of its stages against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from test_operators import brute_components, brute_hits, brute_repeats, measures

import corpus_pipeline
from helixframe.llm import quality
from helixframe.llm.queries import PIECE_MODEL


def voted(t):
    """Votes of the seven rules, written out."""
    n, chars, symbols, dups, repeats = measures(t)
    t = t or ""
    marks, stops = len(re.findall(r"[!-/:-@\[-`{-~]", t)), len(re.findall(r"[.!?]", t))
    lines = sum(1 for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x))
    pairs = [
        (20 * symbols > n, 100 * symbols <= n), (10 * marks > chars, 100 * marks <= 6 * chars), (100 * stops < n or 100 * stops > 60 * n, 3 * n < 100 * stops < 30 * n),
        (5 * dups > lines, 20 * dups <= lines), (5 * repeats > n, 20 * repeats <= n), (chars < 3 * n or chars > 8 * n, 7 * n < 2 * chars < 13 * n), (n < 20, n >= 100),
    ]
    return [-1 if bad else 1 if good else 0 for bad, good in pairs]


def brute_quality(rows):
    """Posterior and verdict of each row by plain expectation-maximisation over the rows."""
    v = np.array([voted(t) for _, t in rows])
    prior, a, b = 0.7, np.full(7, 0.8), np.full(7, 0.8)
    for _ in range(20):
        good, bad = prior * np.ones(len(v)), (1 - prior) * np.ones(len(v))
        for j in range(7):
            good *= np.where(v[:, j] == 1, a[j], np.where(v[:, j] == -1, 1 - a[j], 1))
            bad *= np.where(v[:, j] == -1, b[j], np.where(v[:, j] == 1, 1 - b[j], 1))
        p = good / (good + bad)
        old = prior, a, b
        prior = min(max(p.mean(), 0.05), 0.95)
        a = np.array([(p[v[:, j] == 1].sum() + 8) / (p[v[:, j] != 0].sum() + 10) for j in range(7)])
        b = np.array([((1 - p)[v[:, j] == -1].sum() + 8) / ((1 - p)[v[:, j] != 0].sum() + 10) for j in range(7)])
        if max(abs(prior - old[0]), np.abs(a - old[1]).max(), np.abs(b - old[2]).max()) < 1e-4:
            break
    good, bad = np.full(len(v), prior), np.full(len(v), 1 - prior)
    for j in range(7):
        good *= np.where(v[:, j] == 1, a[j], np.where(v[:, j] == -1, 1 - a[j], 1))
        bad *= np.where(v[:, j] == -1, b[j], np.where(v[:, j] == 1, 1 - b[j], 1))
    p = good / (good + bad)
    base = [n < 50 or 100 * r > 50 * n for n, _, _, _, r in (measures(t) for _, t in rows)]
    return p, [bool(x >= 0.5) and not f for x, f in zip(p, base, strict=True)]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(11)
    voc = ["".join(r.choices("abcdeinorst", k=r.randint(2, 9))) for _ in range(900)]
    sentence = lambda n: " ".join(r.choices(voc, k=n)).capitalize() + "."
    text = lambda n: " ".join(sentence(r.randint(6, 14)) for _ in range(n))
    rows = [(1, None), (2, ""), (3, "too short."), (4, "$$ ## %% " * 60), (5, "again and again " * 80)]
    base = [text(r.randint(8, 30)) for _ in range(40)]
    items = [(f"i{i}", " ".join(r.choices(voc, k=14))) for i in range(6)] + [("none", None), ("empty", "")]
    for i, t in enumerate(base):
        rows.append((10 + i, t))
        w = t.split(" ")
        if i % 4 == 0:  # near copies
            rows += [(200 + 3 * i + j, " ".join(x if r.random() > 0.01 else r.choice(voc) for x in w)) for j in range(3)]
        if i % 5 == 0:  # a passage of another document
            rows.append((400 + i, text(12) + " " + " ".join(base[i - 1].split(" ")[20:60]) + " " + text(6)))
        if i % 6 == 0:
            rows.append((500 + i, text(10) + " " + items[i // 6 % 6][1].upper() + ", " + text(5)))
        if i % 7 == 0:
            rows.append((600 + i, t))
    rows.append((900, text(3_000)))
    root = tmp_path_factory.mktemp("corpus")
    more = [(i, t, len(t or ""), "mine", i % 2 == 0, "x") for i, t in rows]
    spark.createDataFrame(more, "doc_id long, text string, n_chars long, n_words string, kept boolean, items string").repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root), rows, items


def stage(spark, root, name, rows):
    schema = spark.read.parquet(f"{root}/documents.parquet").schema
    given = spark.createDataFrame([(i, t, len(t or ""), "mine", i % 2 == 0, "x") for i, t in rows], schema)
    return dict(corpus_pipeline.STAGES)[name](spark, given, root), given


def test_quality_stage_and_posterior(spark, corpus):
    root, rows, _ = corpus
    out, given = stage(spark, root, "quality rules", rows + rows[:3])
    p, kept = brute_quality(rows + rows[:3])
    assert out.columns == given.columns
    assert sorted(map(tuple, out.collect())) == sorted(tuple(x) for x, k in zip(given.collect(), kept, strict=True) if k)
    assert 10 < sum(kept) < len(kept)
    judged = quality.judged(given.select("doc_id", "text")).toPandas().set_index("doc_id").quality
    assert all(abs(judged.loc[[i]].iloc[0] - x) < 1e-6 for (i, _), x in zip(rows, p, strict=False))


def survivors(rows):
    groups = brute_components(rows, 5, 80)
    return [(i, t) for i, t in rows if groups[i][1] == i]


def cut(rows):
    return [(i, t if not n else kept) for (i, t), (_, words, n, kept) in zip(rows, brute_repeats(rows), strict=True) if not n or n < words]


@pytest.mark.parametrize("name,brute", [("n-gram Jaccard join", survivors), ("substring dedup", cut)])
def test_filter_stage(spark, corpus, name, brute):
    root, rows, _ = corpus
    out, given = stage(spark, root, name, rows)
    assert out.columns == given.columns
    got = {r["doc_id"]: (r["text"], r["n_chars"], r["n_words"], r["kept"], r["items"]) for r in out.collect()}
    assert got == {i: (t, len(t or ""), "mine", i % 2 == 0, "x") for i, t in brute(rows)} and len(got) < len(rows)
    assert stage(spark, root, name, [])[0].count() == 0


def test_decontamination_stage(spark, corpus):
    root, rows, items = corpus
    out, given = stage(spark, root, "benchmark decontamination", rows)
    hits = brute_hits(rows, items)
    assert out.columns == given.columns and {r["doc_id"] for r in out.collect()} == {i for i, _ in rows if not hits[i][1]}
    assert any(n for _, n, _ in hits.values())


def test_run_equals_brute_force(spark, corpus):
    import sentencepiece

    root, rows, items = corpus
    _, kept = brute_quality(rows)
    left = cut(survivors([x for x, k in zip(rows, kept, strict=True) if k]))
    hits = brute_hits(left, items)
    sp, want = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL), {}
    for i, t in left:
        if not hits[i][1]:
            ids = [*sp.encode(t or ""), sp.eos_id()]
            want[i] = (len(ids), ids, hashlib.sha256(sp.decode(ids).encode()).hexdigest())
    out = corpus_pipeline.run(spark, root).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids"], r["decoded_sha256"]) for r in out} == want and len(out) == len(want) > 20
