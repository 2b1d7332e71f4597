import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from pulsegrid.catalog import load_all

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
# model fits and raw files have no SQL of the same meaning
NO_SQL = {"a12_file_manifest", "h01_tree_filler", "h02_tree_forecaster", "h05_day_window_classifier", "h08_classifiers", "h09_discriminant",
          "h11_nested_cv", "h13_settings_search", "h14_drop_one_family", "h15_importance", "h16_vector_head",
          "h17_trained_grid"}
SAMPLE = ["a02_column_maps", "a08_date_sheets", "b08_duration", "b25_scale_train_max", "c09_next_onset", "c11_history_window", "d04_daily", "d07_missingness", "d18_block_stages",
          "d30_segment_summary", "d45_all_and_groups", "d48_bootstrap", "e22_decayed_average", "e26_block_mask", "e33_training_pairs", "f02_strongest_pairs",
          "h04_rhythm_filler", "h17_experiment_grid"]


def ids():
    for fam, n in dict(a=14, b=35, c=21, d=61, e=33, f=7, g=4, h=17, i=3).items():
        for k in range(1, n + 1):
            yield f"{fam}{k:02d}"


def test_every_inventory_id_has_a_query():
    have = {n[:3] for n in load_all()}
    assert [i for i in ids() if i not in have] == []


def test_every_query_has_sql_unless_listed():
    assert {n for n, q in load_all().items() if q.sql is None} == NO_SQL


def test_names_are_plain():
    for n in load_all():
        assert re.fullmatch(r"[a-i]\d\d_[a-z0-9_]+", n)


def test_flagship_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(rows):
    return sorted(tuple("" if v is None else repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", SAMPLE)
def test_spark_equals_sql(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    cur = con.execute(entry.oracle_sql()[name])
    assert [d[0] for d in cur.description] == df.columns
    got = plain(tuple(r) for r in df.collect())
    assert got and got == plain(cur.fetchall())


def test_library_keeps_to_its_rules():
    root = Path(entry.__file__).parent / "pulsegrid"
    text = "\n".join(p.read_text() for p in root.rglob("*.py") if "llm" not in p.parts)
    assert "pulsegrid.llm" not in text
    for word in ("localCheckpoint", "crossJoin", "rand(", "unboundedFollowing", ".rdd"):
        assert word not in text
