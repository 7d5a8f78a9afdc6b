"""Core queries over whole tables and whole texts."""

import pytest

from compare import connect, same
from dossier import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", ["idf_table", "gap_best_match", "gap_verdict", "enrich_bidirectional"])
def test_matching_reads_whole_texts(spark, con, name):
    sql = queries.oracle_sql()[name]
    same(spark, con, queries.queries()[name], sql, FOLDER)


def test_sections_hold_all_events(spark, con, tmp_path):
    query, sql = queries.queries()["section_relabel"], queries.oracle_sql()["section_relabel"]
    assert same(spark, con, query, sql, FOLDER) == 1000
    events = [(1, 1, "view"), (2, 1, "click"), (3, 2, "view"), (4, 2, "error"), (5, 3, "error"), (41, 3, "signup"), (42, 4, "view"), (81, 5, "view"), (82, 5, "error")]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    assert {r.event_id: r.relabel for r in query(spark, str(tmp_path)).collect()} == {1: True, 2: True, 3: True, 4: True, 5: False, 41: False, 42: False, 81: True, 82: True}


def test_places_of_whole_texts(spark, con):
    sql = queries.oracle_sql()["gazetteer_cascade"]
    same(spark, con, queries.queries()["gazetteer_cascade"], sql, FOLDER)


def test_places_far_into_a_text(spark, tmp_path):
    late = "word " * 60
    docs = [(1, f"{late}of the end", "en"), (2, f"the{' x' * 200} nichts", "de"), (3, f"{late}nowhere", "fr"), (4, f"nichts {late}en de", "fr")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.id, r.place, r.tier) for r in queries.queries()["gazetteer_cascade"](spark, str(tmp_path)).collect()}
    assert got == {(1, "of the", 3), (2, "nichts", 4), (4, "en de", 3)}


def test_ids_and_terms_of_whole_tables(spark, con):
    sql, found = queries.oracle_sql(), queries.queries()
    assert same(spark, con, found["collision_suffix"], sql["collision_suffix"], FOLDER) == spark.read.parquet(f"{FOLDER}/part.parquet").count()
    same(spark, con, found["fts_index"], sql["fts_index"], FOLDER)


def test_stems_of_all_languages(spark, tmp_path):
    docs = [(1, "running maps", "en"), (2, "Running die runs", "de"), (3, "maps", None), (4, None, "fr")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.stem: r.df for r in queries.queries()["fts_porter"](spark, str(tmp_path)).collect()}
    assert got == {"run": 2, "map": 2, "die": 1}


def test_stems_of_folded_words(spark, tmp_path):
    docs = [(1, "Kéy KEYS café_Ünd", "fr"), (2, "中文 x² Ель", "zh")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.stem: r.df for r in queries.queries()["fts_porter"](spark, str(tmp_path)).collect()}
    assert got == {"kei": 1, "cafe": 1, "und": 1, "中文": 1, "x²": 1, "ель": 1}
