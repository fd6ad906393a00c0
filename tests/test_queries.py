"""Every query with SQL equals DuckDB's result on the smallest tables."""

import duckdb
import pytest

from helixframe import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def text(v):
    if v is None or (isinstance(v, float) and v != v):
        return "NULL"
    return f"{v:.6g}" if isinstance(v, float) and v else "0" if isinstance(v, float) else str(v)


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(text(r[i]) for i in order) for r in rows)


# One query of each module here; the driver compares all of them.
CHOSEN = ["a7_omics_features", "a15_row_features", "w3_combat", "w8_kaplan_meier", "w10_log_rank", "f5_f6_f7_f8_neoantigens", "f10_f11_w12_guide_library", "f23_w11_treatment_plan", "g3_shortest_paths", "a33_classification_metrics", "j9_m11_spearman_screen", "s16_flatten_civic", "r1_daily_mean", "m12_fusion_ranking"]


@pytest.mark.parametrize("name", CHOSEN)
def test_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(registry.oracles()[name])
    assert got == table([c[0] for c in cursor.description], cursor.fetchall())


def test_all_have_names_and_sql():
    assert set(registry.oracles()) <= set(registry.queries())
    assert len(registry.queries()) > 110
