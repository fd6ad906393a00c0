"""Each operator against a brute-force version or an exact round trip, with nulls, empty and repeated rows, ties,
clashing columns and empty tables."""

import json
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from helixframe.llm import chat, decontaminate, license_scan, ngram_join, quality, sentencepiece_codec, sharding, sql, substring, token_io, toxicity
from helixframe.llm.queries import PIECE_MODEL, WORD_TOKENIZER

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = [(1, None), (2, ""), (3, "  \n "), (4, "a"), (4, "a"), (5, "A b c"), (6, "x " * 4000)]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def prose(seed, n, words=200):
    r = random.Random(seed)
    voc = [f"w{i}" for i in range(words)]
    passages = [r.choices(voc, k=r.randint(13, 60)) for _ in range(6)]
    out = []
    for i in range(n):
        w = []
        for _ in range(r.randint(1, 4)):
            w += r.choice(passages) if r.random() < 0.4 else r.choices(voc, k=r.randint(1, 40))
        out.append((i + 10, r.choice([" ", "\n", "  "]).join(w)))
    return EDGE + out + [(i + 5000, t) for i, t in out[:10]]


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def test_chat_layouts_and_round_trip(spark):
    records = [
        (1, '{"messages":[{"role":"user","content":"<|im_end|> a\\\\b"},{"role":"assistant","content":null}]}'),
        (2, '{"instruction":"do","input":"","output":"[INST]"}'),
        (3, '{"conversations":[{"from":"human","value":"hi"},{"from":"gpt","value":"yo"}]}'),
        (4, '{"odd":1}'), (5, None), (6, '{"response":"r","prompt":"p"}'),
        (7, '{"id":7,"prompt":"p","response":"r","meta":{"a":[1]}}'), (8, '{"messages":[{"role":"user","name":"n","content":[{"type":"text","text":"x"},{"type":"text","text":"y"}]},{"role":"assistant","content":"z"}]}'),
        (9, '{"prompt":"p","response":"r","tools":["t"]}'), (9, '{"prompt":"p","response":"r","tools":["t"]}'), (10, json.dumps({"prompt": "<s>" * 50_000, "response": ""})),
    ]
    turns = chat.canonical_turns(spark.createDataFrame(records, "id long, record string").withColumn("role", F.lit("clash")), "id", "record")
    assert {(r["layout"], r["records"]) for r in chat.layouts(turns).collect()} == {("messages", 2), ("instruction", 1), ("sharegpt", 1), ("prompt", 3), (None, 1), (None, 2)}
    rows = {(r["id"], r["step"]): (r["layout"], r["role"], r["text"]) for r in turns.collect()}
    assert rows[1, 0] == ("messages", "user", "<|im_end|> a\\b") and rows[1, 1] == ("messages", "assistant", "")
    assert rows[2, 0] == ("instruction", "user", "do") and rows[3, 0] == ("sharegpt", "user", "hi") and rows[6, 1] == ("prompt", "assistant", "r")
    assert rows[7, 0] == ("prompt", "user", "p") and rows[8, 0] == ("messages", "user", "xy") and rows[8, 1][2] == "z" and rows[9, 0] == (None, None, None)
    assert rows[4, 0] == (None, None, None) and rows[5, 0] == (None, None, None)
    out = chat.format_turns(turns.where("layout IS NOT NULL"), "id", ["step"])
    for r in out.collect():
        read = chat.CHATML.read(r["formatted"])
        assert read == [rows[r["id"], s][1:] for s in range(len(read))]
        assert "".join(chat.CHATML.unescape(r["formatted"][s["start"] : s["end"]]) for s in r["loss_spans"]) == "".join(t for role, t in read if role == "assistant")
    assert chat.format_turns(turns.limit(0), "id", ["step"]).count() == 0 and chat.read_back(chat.format_turns(turns.limit(0), "id", ["step"]), "id").count() == 0
    twice = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, None, None), (2, 0, "assistant", "")], "id long, step int, role string, text string").withColumn("formatted", F.lit("clash"))
    read = {r["id"]: (r["n_turns"], r["loss_chars"]) for r in chat.read_back(chat.format_turns(twice, "id", ["step"]), "id").collect()}
    assert read == {1: (3, 0), 2: (1, 0)}


U, A = {"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}


@pytest.mark.parametrize(
    "record,layout,turns",
    [
        ({"system": "s", "conversations": [{"from": "human", "value": "q"}]}, "sharegpt", [("system", "s"), ("user", "q")]),
        ({"system": " ", "messages": [U, A]}, "messages", [("user", "q"), ("assistant", "a")]),
        ({"messages": [U, {"role": "assistant", "content": None, "tool_calls": [{"id": "c", "function": {"name": "f"}}]}, {"role": "tool", "tool_call_id": "c", "content": "3"}]}, "messages", [("user", "q"), ("assistant", '[{"id": "c", "function": {"name": "f"}}]'), ("tool", "3")]),
        ({"messages": [{"role": "user", "content": [{"type": "text", "text": "x"}, {"type": "image_url", "image_url": {"url": "u"}}]}]}, "messages", [("user", 'x{"type": "image_url", "image_url": {"url": "u"}}')]),
        ({"prompt": [U], "completion": [A]}, "prompt messages", [("user", "q"), ("assistant", "a")]),
        ({"prompt": [U], "response": "r"}, "prompt messages, response", [("user", "q"), ("assistant", "r")]),
        ({"messages": []}, "messages", [(None, None)]),
        ({"messages": [{"role": "user", "content": {"id": 3}}]}, None, [(None, None)]),
        ({"messages": [{"role": "user", "content": "x", "more": {"id": 3}}]}, None, [(None, None)]),
    ],
)
def test_chat_mixed_layouts(spark, record, layout, turns):
    rows = chat.canonical_turns(spark.createDataFrame([(1, json.dumps(record))], "id long, record string"), "id", "record").orderBy("step").collect()
    assert [(r["role"], r["text"]) for r in rows] == turns and {r["layout"] for r in rows} == {layout}


def test_every_fingerprint_has_one_mapping():
    all_ = [(f, m.name) for m in chat.MAPPINGS for f in set(m.fingerprints())]
    assert len({f for f, _ in all_}) == len(all_)


def test_fingerprint_ignores_order():
    assert chat.fingerprint(chat.field_paths({"a": 1, "b": [{"c": 2}, {"d": 3}]})) == chat.fingerprint(chat.field_paths({"b": [{"d": 0, "c": 0}], "a": ""}))


@pytest.mark.parametrize("xor", [False, True])
def test_toxicity_learns_pairs_and_holds_out(spark, xor):
    r = random.Random(1)
    rows, labels = [], []
    for i in range(2000):
        words = [f"n{r.randrange(40)}" for _ in range(8)]
        insult, group = r.random() < 0.5, r.random() < 0.5
        rows.append((i, " ".join(words + ["insultum"] * insult + ["groupus"] * group)))
        labels.append((i, int((insult != group) if xor else (insult and group))))
    more = [(9001, None), (9002, ""), (9003, "x " * 50_000), (3, rows[3][1])]
    scored = toxicity.toxicity_scores(docs(spark, rows + more).withColumn("score", F.lit("clash")), spark.createDataFrame(labels + labels[:9] + [(5, None), (None, 1)], "doc_id long, toxic int")).toPandas()
    truth = dict(labels)
    held = scored[scored.held_out & scored.doc_id.isin(truth)]
    assert (held.predicted == held.doc_id.map(truth)).mean() > 0.95
    assert ((scored.score >= 0) & (scored.score <= 1)).all() and len(scored) == 2004
    assert all((zlib.crc32(str(i).encode()) % 3 == 1) == h for i, h in zip(scored.doc_id, scored.held_out, strict=True))
    none = toxicity.toxicity_scores(docs(spark, rows[:3]), spark.createDataFrame([], "doc_id long, toxic int")).toPandas()
    assert (none.score == 0.5).all()
    assert toxicity.toxicity_scores(docs(spark, rows[:3]).limit(0), spark.createDataFrame(labels[:9], "doc_id long, toxic int")).count() == 0


def test_factors_stay_when_single_terms_tell_and_a_planted_pair_counts():
    r = np.random.default_rng(4)
    rows, labels = [], []
    for _ in range(1500):
        own = set(r.choice(60, 8, replace=False).tolist())
        one, other, both = r.random() < 0.1, r.random() < 0.5, r.random() < 0.5
        rows.append(np.array(sorted(own | {100 + i for i, x in enumerate((one, other, both)) if x}), np.int32))
        labels.append(float(one or (other and both)))
    m = toxicity.FactorizationMachine.learn(rows, np.array(labels))
    at = m.place[[100, 101, 102]]
    pairs = m.factors @ m.factors.T
    assert np.abs(m.factors).max() > 0
    # The planted pair weighs more than any pair of harmless terms.
    rest = np.abs(pairs[np.ix_(m.place[:60], m.place[:60])] - np.diag(np.diag(pairs[np.ix_(m.place[:60], m.place[:60])])))
    assert pairs[at[1], at[2]] > rest.max()
    assert m.logits(at[:1], np.array([0]), 1)[0] > 0.5


def test_factorization_machine_sums_all_pairs():
    r = np.random.default_rng(2)
    place = np.full(toxicity.BUCKETS, -1, np.int32)
    texts = ["a b c d", "", None, "a a a stupidity", "z"]
    buckets, of = toxicity._terms(pa.array(texts))
    known = np.unique(buckets)[:-1]
    place[known] = np.arange(len(known))
    m = toxicity.FactorizationMachine(0.3, r.normal(size=len(known)), r.normal(size=(len(known), 3)), place)
    for i, score in enumerate(m.scores(pa.array(texts))):
        rows = [place[b] for b, t in zip(buckets, of, strict=True) if t == i and place[b] >= 0]
        logit = 0.3 + sum(m.linear[x] for x in rows) + sum(float(m.factors[x] @ m.factors[y]) for k, x in enumerate(rows) for y in rows[:k])
        assert abs(score - 1 / (1 + np.exp(-logit))) < 1e-9


def brute_licenses(ids):
    """Rules in order over a list of id@version, by position and with marks of what is used."""
    used, names = [False] * len(ids), []
    for name, rule in license_scan.RULES:
        i = 0
        while i < len(ids):
            j, ok = i, True
            for k in rule:
                if j < len(ids) and not used[j] and ids[j].split("@")[0] == k.rstrip("?"):
                    j += 1
                elif not k.endswith("?"):
                    ok = False
                    break
            if ok:
                names.append(name.replace("{v}", ids[i].split("@")[1]))
                used[i:j] = [True] * (j - i)
                i = j
            else:
                i += 1
    return names, used.count(False)


def test_license_rules(spark):
    S = license_scan.SENTENCES
    mit = S["mit-grant"] + S["mit-notice"]
    apache = "# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with\n#  the License.\n# You may obtain a copy of the License at\n#\n#     http://www.apache.org/licenses/LICENSE-2.0\n#\n# Unless required by applicable law or agreed to in writing, software distributed\n# under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR\n# CONDITIONS OF ANY KIND, either express or implied."
    wrapped = "\n * ".join(re.sub(r"(.{30}\S*) ", r"\1\n * ", x) for x in mit)
    texts = {
        1: ("Intro.\nLicensed under the Apache License, Version 2.0.\nmore", ["Apache-2.0"], 0), 2: ("\n".join(mit), ["MIT"], 0), 3: ("All rights reserved. All rights reserved.", ["All-rights-reserved"] * 2, 0),
        4: (None, [], 0), 5: ("", [], 0), 6: ("\n".join(mit + mit), ["MIT", "MIT"], 0), 7: ("\n".join([*S["mit-grant"], *S["bsd-use"], *S["bsd-as-is"], *S["mit-notice"]]), ["BSD-2-Clause"], 2),
        8: (apache, ["Apache-2.0"], 0), 9: (wrapped, ["MIT"], 0), 10: ("// SPDX-License-Identifier: GPL-2.0-only", ["GPL-2.0-only"], 0), 11: ("word " * 50_000 + "\n\nReleased under the MIT License.", ["MIT"], 0),
        12: ("Licensed under CC BY 4.0\nand more words here", ["CC-BY-4.0"], 0),
    }
    rows = [(i, t) for i, (t, _, _) in texts.items()]
    r = random.Random(6)
    every = [s for each in S.values() for s in each]
    rows += [(100 + i, r.choice(["\n", " ", "\n\n"]).join(r.choice(every) for _ in range(r.randint(1, 9)))) for i in range(150)]
    out = license_scan.scan_licenses(docs(spark, rows + rows[:2]).withColumn("licenses", F.lit("clash"))).collect()
    assert len(out) == len(rows) + 2
    got = {x["doc_id"]: (x["licenses"], x["n_unmatched"]) for x in out}
    assert {i: got[i] for i in texts} == {i: (names, n) for i, (_, names, n) in texts.items()}
    assert all(got[x["doc_id"]] == brute_licenses(x["sentence_ids"]) for x in out)
    assert all(re.search(license_scan.TRIGGERS, s.lower()) for s in every)
    assert license_scan.scan_licenses(docs(spark, rows).limit(0)).count() == 0


APACHE = "Licensed under the Apache License, Version 2.0"
TAG = "SPDX-License-Identifier:"


@pytest.mark.parametrize(
    ("text", "names", "expressions"),
    [
        (f"// {TAG} MIT\n// {TAG} Apache-2.0\n", ["MIT", "Apache-2.0"], ["MIT", "Apache-2.0"]),
        (f"# {TAG} BSD-3-Clause\n{APACHE}.\n", ["Apache-2.0", "BSD-3-Clause"], ["BSD-3-Clause"]),
        (f"{TAG} MIT OR Apache-2.0", ["MIT", "Apache-2.0"], ["MIT OR Apache-2.0"]),
        (f"/* {TAG} ( MIT OR  Apache-2.0 ) */", ["MIT", "Apache-2.0"], ["(MIT OR Apache-2.0)"]),
        (f"{TAG} GPL-2.0-only WITH Classpath-exception-2.0", ["GPL-2.0-only WITH Classpath-exception-2.0"], ["GPL-2.0-only WITH Classpath-exception-2.0"]),
        (f"Copyright 2020 Foo\n{APACHE} (the \"License\");\nyou may not use this file except in compliance with the License.", ["Apache-2.0"], []),
        ("This software is licensed under the MIT license", ["MIT"], []),
        (f"{TAG} MIT AND (ISC OR (Zlib AND 0BSD)) and prose OR", ["MIT", "ISC", "Zlib", "0BSD"], ["MIT AND (ISC OR (Zlib AND 0BSD))"]),
        (f"a {TAG} MIT b {TAG} ISC. All rights reserved.", ["MIT", "ISC", "All-rights-reserved"], ["MIT", "ISC"]),
        (f"{TAG} {' OR '.join(['LicenseRef-a'] * 20_000)}", ["LicenseRef-a"] * 20_000, [" OR ".join(["LicenseRef-a"] * 20_000)]),
        (f"x\n{APACHE}\ny\nReleased under the MIT License\n" + "z\n" * 50_000, ["Apache-2.0", "MIT"], []),
        (f"{TAG} \n{TAG}( ) MIT", [], []),
    ],
)
def test_license_expressions_and_headers(spark, tmp_path, text, names, expressions):
    out = license_scan.scan_licenses(docs(spark, [(1, text)])).first()
    assert (out["licenses"], out["expressions"]) == (names, expressions)
    if len(text) < 10_000:
        pq.write_table(pa.table({"doc_id": [1, 2], "text": [text, None]}), tmp_path / "documents.parquet")
        told = duckdb.sql(sql.op3_sql().replace("FROM documents", f"FROM '{tmp_path}/documents.parquet'")).df().set_index("doc_id")
        assert (told.licenses[1], told.expressions[1], told.n_sentences[2]) == (",".join(names), ";".join(expressions), 0)


INNER = ["at", "bits", "bucket", "doc", "from", "l", "m", "may", "n", "part", "place", "ranges", "seq", "tid", "v0", "v1", "w", "whole", "word"]


@pytest.mark.parametrize(
    "operator",
    [license_scan.scan_licenses, quality.judged, sharding.assign_shards, substring.without_repeats],
)
def test_columns_named_like_inner_ones_come_through(spark, operator):
    rows = prose(11, 12)
    df = docs(spark, rows)
    plain = operator(df)
    clash = df.withColumns({f"_{c}": F.concat(F.lit(c), F.coalesce("text", F.lit(""))) for c in INNER} | {f"__{c}": F.lit(1) for c in INNER})
    out = operator(clash)
    assert all((r[f"_{c}"], r[f"__{c}"]) == (c + (r["text"] or ""), 1) for r in out.collect() for c in INNER)
    assert Counter(map(str, out.select(*plain.columns).collect())) == Counter(map(str, plain.collect()))


def measures(t):
    t = t or ""
    w = WORD.findall(t)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count, cover = Counter(tri), np.zeros(len(w), bool)
    for i, x in enumerate(tri):
        if count[x] > 1:
            cover[i : i + 3] = True
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), int(cover.sum())


def test_quality_measures_and_votes(spark):
    rows = prose(3, 60) + [(900, "a# $b\nx\nx\n\n x"), (901, "é ü　ß |")]
    out = quality.judged(docs(spark, rows).withColumn("kept", F.lit("clash"))).toPandas()
    got = sorted(out[["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]].itertuples(index=False, name=None))
    assert got == sorted((i, *measures(t)) for i, t in rows)
    assert not out[out.base_failed].kept.any() and (out.base_failed == ((out.n_words < 50) | (100 * out.n_repeat_words > 50 * out.n_words))).all()
    assert quality.judged(docs(spark, rows).limit(0)).count() == 0


def test_em_prefers_agreeing_rules(spark):
    r = random.Random(2)
    data = []
    for _ in range(2000):
        good = r.random() < 0.7
        vote = lambda a, good=good: 0 if r.random() < 0.2 else (1 if good else -1) * (1 if r.random() < a else -1)
        data.append((vote(0.95), vote(0.9), vote(0.6)))
    w = quality.learned(spark.createDataFrame(data, "a int, b int, c int"), ["a", "b", "c"])
    assert abs(w.prior - 0.7) < 0.08 and w.good[0] > w.good[2] and w.bad[0] > w.bad[2]


def brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall(lower(t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            o = len(sets[a] & sets[b])
            if a < b and o and 100 * o >= percent * (len(sets[a]) + len(sets[b]) - o):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("k,percent,small", [(3, 90, False), (5, 80, False), (5, 80, True)])
def test_ngram_join(spark, monkeypatch, k, percent, small):
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    if small:  # shuffled lists, and blocks of many cells
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        monkeypatch.setattr(ngram_join, "CELL", 3)
        monkeypatch.setattr(ngram_join, "HELD", 4)
    r = random.Random(5)
    voc = [f"w{i}" for i in range(300)]
    base = [r.choices(voc, k=r.randint(20, 120)) for _ in range(8)]
    rows = [(1, None), (2, ""), (3, " "), (4, "a b"), (5, "A B"), (6, "a b c")]
    for i in range(10, 150):
        w = list(r.choice(base))
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = r.choice(voc)
        rows.append((i, " ".join(w[: len(w) - r.choice([0, 0, 4])])))
    rows.append((151, " ".join(r.choices(voc, k=30_000))))
    frame = docs(spark, rows + rows[-3:]).withColumn("n_shingles", F.lit("clash"))
    out = ngram_join.jaccard_components(frame, k=k, percent=percent, rounds=0 if small else 2).collect()
    assert len(out) == len(rows) + 3
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == brute_components(rows, k, percent)
    assert small or ngram_join.jaccard_components(frame.limit(0), k=k, percent=percent).count() == 0


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_prefix_tree_keeps_every_link(percent):
    rng, rule = np.random.default_rng(1), ngram_join.Rule(percent)
    base = rng.permutation(60)
    sets = [np.unique(np.concatenate((base[: rng.integers(2, 40)], rng.integers(0, 60, rng.integers(0, 4))))) for _ in range(80)]
    prefix = [s[: rule.prefix(len(s))] for s in sets]
    for a in range(len(sets)):
        for b in range(a):
            # In the block of the first token that both prefixes share, the tree must give every pair that links.
            both, o = np.intersect1d(prefix[a], prefix[b]), len(np.intersect1d(sets[a], sets[b]))
            links = 100 * o >= percent * (len(sets[a]) + len(sets[b]) - o)
            if not len(both):
                assert not links
                continue
            x, y = (prefix[i][prefix[i] >= both[0]] for i in (a, b))
            entry = [(i, len(sets[i]), int(prefix[i][-1]), i) for i in (a, b)]
            tree = ngram_join.PrefixTree(y[:0], entry[1])
            tree.add(y, entry[1])
            assert rule.inside_any(len(sets[a]), len(sets[b]) - 3, len(sets[b]) + 3) <= max(1, min(rule.inside(len(sets[a]), len(sets[b])), rule.inside(len(sets[b]), len(sets[a])))) or not rule.near(len(sets[a]), len(sets[b]))
            assert not links or list(tree.candidates(x, entry[0], rule)) == [b]
    tree = None
    for i, s in enumerate(prefix):
        entry = (i, len(sets[i]), int(s[-1]), i)
        tree = tree or ngram_join.PrefixTree(s[:0], entry)
        tree.add(s, entry)
    for i, s in enumerate(prefix):
        entry = (i, len(sets[i]), int(s[-1]), i)
        need = lambda j: rule.inside(len(sets[i]), len(sets[j])) if s[-1] <= prefix[j][-1] else rule.inside(len(sets[j]), len(sets[i]))  # noqa: B023, E731
        want = {j for j in range(len(sets)) if j != i and rule.near(len(sets[i]), len(sets[j])) and len(np.intersect1d(s, prefix[j])) >= need(j)}
        assert set(tree.candidates(s, entry, rule)) == want


ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(rows, items):
    windows = {}
    for i, t in items:
        w = ALNUM.findall(lower(t or ""))
        m = min(len(w), 10)
        for k in range(len(w) - m + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + m]), set()).add(i)
    want = {}
    for i, t in rows:
        w = ALNUM.findall(lower(t or ""))
        hit, met = np.zeros(len(w), bool), set()
        for m in {len(p) for p in windows}:
            for k in range(len(w) - m + 1):
                if (own := windows.get(tuple(w[k : k + m]))) is not None:
                    hit[k : k + m] = True
                    met |= own
        want[i] = (len(w), int(hit.sum()), sorted(met, key=str))
    return want


def test_decontamination(spark, monkeypatch):
    r = random.Random(4)
    voc = [f"v{i}" for i in range(30)]
    items = [(i, " ".join(r.choices(voc, k=r.randint(1, 25)))) for i in range(12)] + [(50, None), (51, ""), (52, "Solo"), (53, "solo"), (3, "another text of item three"), (None, "no name at all"), (None, "no name again")]
    rows = [(1, None), (2, ""), (3, "SOLO, solo!"), (4, "No name at all; " + "v1 " * 20_000), (4, "No name at all; " + "v1 " * 20_000)]
    for i in range(10, 80):
        w = r.choices(voc, k=r.randint(0, 30))
        if r.random() < 0.4:
            w += (r.choice(items)[1] or "").upper().split()
        rows.append((i, "; ".join(w)))
    want, bench = brute_hits(rows, items), spark.createDataFrame(items, "item_id long, text string")
    kept, write = [], decontaminate.written
    monkeypatch.setattr(decontaminate, "written", lambda df, tag: kept.append(df.columns) or write(df, tag))
    for limit in (decontaminate.MAX_ITEM_BYTES, 200, 20):
        out = decontaminate.search_items(docs(spark, rows).withColumn("n_hit", F.lit("clash")), bench, limit=limit).collect()
        assert len(out) == len(rows)
        assert {x["doc_id"]: (x["n_words"], x["n_hit"], x["items"]) for x in out} == want
        assert all(sum(s["end"] - s["start"] for s in x["hits"]) == x["n_hit"] for x in out)
    assert kept and all("text" not in columns for columns in kept)  # only occurrences are written
    assert decontaminate.search_items(docs(spark, rows), bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.search_items(docs(spark, rows).limit(0), bench).count() == 0


def test_sharding(spark):
    import hashlib

    def draw(k, s):
        return (int(hashlib.md5(f"{k}:{s}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52

    frame = spark.range(3000).withColumn("slot", F.lit("clash"))
    one = {r["id"]: (r["shard"], r["slot"]) for r in sharding.assign_shards(frame, "id", (1.0,) * 5).collect()}
    more = {r["id"]: r["shard"] for r in sharding.assign_shards(frame, "id", (1.0,) * 6).collect()}
    assert all(s == max(range(5), key=lambda j: draw(i, j)) for i, (s, _) in one.items())
    assert all(more[i] in (s, 5) for i, (s, _) in one.items()) and any(s == 5 for s in more.values())
    for shard in range(5):
        assert sorted(t for s, t in one.values() if s == shard) == list(range(sum(s == shard for s, _ in one.values())))
    weighted = {r["id"]: r["shard"] for r in sharding.assign_shards(frame, "id", (1.0, 3.0, 0.0)).collect()}
    assert all(s == max((0, 1), key=lambda j: -(1.0, 3.0)[j] / np.log(draw(i, j))) for i, s in weighted.items())
    assert 0.2 < Counter(weighted.values())[0] / 3000 < 0.3
    repeated = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (None, None)], "id long, t string")
    slots = {n: [(r["id"], r["t"], r["shard"], r["slot"]) for r in sharding.assign_shards(repeated.repartition(n), "id", ties=["t"]).collect()] for n in (1, 3)}
    assert sorted(map(str, slots[1])) == sorted(map(str, slots[3])) and len({x[2:] for x in slots[1]}) == 4
    assert sharding.assign_shards(frame.limit(0), "id").count() == 0


def brute_repeats(rows):
    """(key, words, words removed, words kept) of each row."""
    first, tokens = {}, [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in tokens:
        for k in range(len(w) - 12):
            first[tuple(w[k : k + 13])] = min(i, first.get(tuple(w[k : k + 13]), i))
    out = []
    for i, w in tokens:
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = True
        out.append((i, len(w), int(gone.sum()), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("hot", [500, 5, 0])
def test_substring_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(substring, "HOT", hot or 5)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m" if hot else "-1")
    rows = prose(7, 120)
    out = substring.without_repeats(docs(spark, rows).withColumn("n_removed", F.lit("clash"))).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in out) == sorted(brute_repeats(rows))
    assert substring.without_repeats(docs(spark, rows).limit(0)).count() == 0


def test_direct_codes():
    values = np.random.default_rng(1).integers(0, 70000, 5000).astype(np.uint32)
    values[:3] = 0, 2**32 - 1, 255
    codes = token_io.DirectCodes.from_bytes(token_io.DirectCodes.encode(values).to_bytes())
    assert (codes.decode() == values).all() and all(codes.get(i) == values[i] for i in range(0, 5000, 7))
    assert len(token_io.DirectCodes.from_bytes(token_io.DirectCodes.encode(values[:0]).to_bytes()).decode()) == 0


TEXTS = ["", " ", "  a  b ", "The the, THE!", "İ Σ é́ ŉ", "a\tb\x00c　d", "<|endoftext|> </w> '' 's", "😀 中文 ▁x", "=" * 300, "hahaha" * 50, "a" * 500]


def test_token_file_round_trip(spark):
    from tokenizers import Tokenizer

    rows = [(i * 3, t) for i, t in enumerate(TEXTS)] + [(1, None)]
    path = token_io.token_path(spark)
    token_io.write_tokens(docs(spark, rows), path, WORD_TOKENIZER, block_chars=300)
    own = Tokenizer.from_file(WORD_TOKENIZER)
    want, at = {}, 0
    for i, t in sorted(rows):
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 1]
        want[i] = (at, ids)
        at += len(ids)
    assert {r["doc_id"]: (r["start"], r["ids"]) for r in token_io.read_tokens(spark, path).collect()} == want
    assert token_io.token_at(spark, path, at - 1) == 1 and token_io.token_at(spark, path, at) is None


def test_token_file_of_repeated_keys_and_nothing(spark):
    rows = [(5, "b"), (5, "a"), (5, "a"), (None, "none"), (2, "x " * 30_000)]
    path = token_io.token_path(spark)
    token_io.write_tokens(docs(spark, rows).withColumn("key", F.lit("clash")), path, WORD_TOKENIZER, block_chars=50)
    out = sorted(token_io.read_tokens(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in out] == [None, 2, 5, 5, 5] and [r["start"] for r in out] == np.cumsum([0] + [r["n_tokens"] for r in out])[:-1].tolist()
    assert out[1]["n_tokens"] == 30_001 and len({tuple(r["ids"]) for r in out[2:]}) == 2
    path = token_io.token_path(spark)
    token_io.write_tokens(docs(spark, rows).limit(0), path, WORD_TOKENIZER)
    assert token_io.read_tokens(spark, path).count() == 0


def test_components_of_chains_and_stars(spark):
    from helixframe.llm.components import connected_components

    r = random.Random(8)
    order = r.sample(range(1000, 1060), 60)
    links = list(zip(order[:-1], order[1:], strict=True)) + [(5, i) for i in range(6, 40)] + [(7, 7), (None, 3), (80, 81), (81, 80)]
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == dict.fromkeys(order, min(order)) | dict.fromkeys(range(5, 40), 5) | {80: 80, 81: 80}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sentencepiece_equals_library(spark):
    import sentencepiece

    r = random.Random(3)
    bits = ["a", "b", "the", " ", "  ", "\n", "▁", "é", "ﬁ", "中", "😀", "er", ".", "$$$", "aaaa", "----", "0"]
    texts = TEXTS + ["".join(r.choices(bits, k=r.randint(0, 50))) for _ in range(300)]
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    out = sentencepiece_codec.encode_decode(docs(spark, list(enumerate(texts)) + [(-1, None)]).withColumn("ids", F.lit("clash")), PIECE_MODEL).collect()
    assert len(out) == len(texts) + 1
    twice = sentencepiece_codec.encode_decode(docs(spark, [(1, "a b"), (1, "a b")]), PIECE_MODEL).collect()
    assert len(twice) == 2 and twice[0] == twice[1] and sentencepiece_codec.encode_decode(docs(spark, [(1, "a")]).limit(0), PIECE_MODEL).count() == 0
    for x in out:
        ids = [*sp.encode("" if x["doc_id"] < 0 else texts[x["doc_id"]]), 2]
        assert x["ids"] == ids and x["decoded"] == sp.decode(ids)


def test_words_at_text_edges():
    from helixframe.llm._words import NOT_SPACE, Words, sliced

    column = pa.array(["ab", "cd e", None, "", "ab"])
    w = Words(column, NOT_SPACE, lower=False)
    assert [w.text(i) for i in range(4)] == [b"ab", b"cd", b"e", b"ab"] and w.hash[0] == w.hash[3] and w.count.tolist() == [1, 2, 0, 0, 1]
    batch = pa.RecordBatch.from_arrays([column], ["t"])
    assert [b.num_rows for b in sliced([batch], "t", 4)] == [1, 3, 1]


def test_fm_index_matching_statistics():
    r = np.random.default_rng(3)
    passages = [r.integers(0, 12, r.integers(3, 40)) for _ in range(60)]
    sizes, owners = np.array([len(p) for p in passages]), r.permutation(60)
    index = substring.FmIndex(np.concatenate(passages), sizes, owners, 16)
    streamed = [*passages[:10], *(r.integers(-1, 14, 30) for _ in range(10))]
    flat = np.concatenate(streamed)
    first = np.repeat(np.cumsum([len(p) for p in streamed]) - [len(p) for p in streamed], [len(p) for p in streamed])
    length, low, high = index.matching_statistics(flat, first, 8)
    for j in range(len(flat)):
        met = lambda m: [o for p, o in zip(passages, owners, strict=True) for i in range(len(p) - m + 1) if (p[i : i + m] == flat[j - m + 1 : j + 1]).all()]  # noqa: B023, E731
        longest = max((m for m in range(1, min(8, j - first[j] + 1) + 1) if met(m)), default=0)
        assert length[j] == longest
        if longest:
            assert high[j] - low[j] == len(met(longest)) and index.smallest_owner(low[j : j + 1], high[j : j + 1])[0] == min(met(longest))


def test_wavelet_tree_is_compressed():
    r = np.random.default_rng(4)
    symbols = np.minimum(r.geometric(0.3, 5000), 200)
    tree = substring.WaveletTree(symbols, 300)
    p = np.bincount(symbols)[np.bincount(symbols) > 0] / 5000
    assert sum(64 * len(b) for b in tree.bits) < 5000 * (1 - (p * np.log2(p)).sum()) + 64 * 300
    at = r.integers(0, 5001, 400)
    some = symbols[r.integers(0, 5000, 400)]
    assert tree.rank(some, at).tolist() == [int((symbols[:a] == s).sum()) for s, a in zip(some, at, strict=True)]
    one = substring.WaveletTree(np.zeros(5, np.int64), 1)
    assert one.rank(np.zeros(2, np.int64), np.array([2, 5])).tolist() == [2, 5]
