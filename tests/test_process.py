"""The decision tree of processes, captures at first sight, a database that isn't there."""

import pytest

from dossier.plans import projects
from dossier.sources import readers


def test_process_by_jurisdiction(spark):
    t = lambda rows, schema: spark.createDataFrame(rows, schema)
    stages = t([("iaa", "plan", "Planning", 1, None), ("ceaa", "rev", "Review", 3, None), ("bc_2002", "app", "Application", 2, None), ("bc_2018", "early", "Early", 1, None), ("on_rea", "done", "Done", 5, None)], "framework string, stage string, label string, macro int, range string")
    by_type = t([("_default", "iaa"), ("Old", "ceaa")], "type string, framework string")
    phases = t([("A", "Review", 2), ("A", "Planning", 1), ("X", "nowhere", 1)], "name string, phase string, ord int")
    by_phase = t([("Planning", "iaa", "plan"), ("Review", "ceaa", "rev")], "phase string, framework string, stage string")
    by_status = t([("Completed", 5, "4-5", "approved")], "status string, macro int, range string, outcome string")
    bc = t([("Early Engagement", "early", "s1", None, None), ("Process Planning", "app", None, None, None), ("Pre-Application", "zzz", None, None, "unknown"), ("Certified", None, None, "approved", None)], "phase string, stage string, sub string, outcome string, confidence string")
    rea = t([("on_rea", "done", 4)], "framework string, stage string, macro int")
    F_, B = projects.FEDERAL, projects.BC
    rows = [(1, F_, "A", "Old", "Completed"), (2, F_, "B", "Old", "Completed"), (3, F_, "X", None, "other"), (4, B, "C", None, "Early Engagement"), (5, B, "D", None, "Process Planning"), (6, B, "E", None, "Pre-Application"), (7, B, "F", None, "Certified"), (8, B, "G", None, None), (9, projects.ONTARIO_REA, "H", None, None), (10, projects.ONTARIO_EA, "I", None, None), (11, "Yukon", "A", "Old", "Completed"), (12, None, None, None, None)]
    got = {r.k: tuple(r)[5:] for r in projects.derive_process(t(rows, "k int, jurisdiction string, name string, type string, status string"), stages, by_type, phases, by_phase, by_status, bc, rea).collect()}
    assert got == {
        1: ("iaa", "plan", "Planning", 1, None, None, None, "e"),
        2: ("ceaa", None, None, 5, "4-5", None, "approved", "i"),
        3: ("iaa", None, None, None, None, None, None, "u"),
        4: ("bc_2018", "early", "Early", 1, None, "s1", None, "e"),
        5: ("bc_2002", "app", "Application", 2, None, None, None, "e"),  # the later act lacks the stage
        6: ("bc_2002", "zzz", "Pre-Application", None, None, None, None, "u"),
        7: ("bc_2002", None, None, None, None, None, "approved", "e"),
        8: ("bc_2002", None, None, None, None, None, None, "u"),
        9: ("on_rea", "done", "Done", 4, None, None, None, "i"),
        10: ("on_ea", None, None, None, None, None, None, "u"),
        11: (None, None, None, None, None, None, None, "u"),
        12: (None, None, None, None, None, None, None, "u"),
    }


def test_captures_at_first_sight(spark):
    rows = [("h", "http://h/a.pdf", "2003", "200", "application/pdf"), ("h", "http://h/a.pdf", "2001", "404", "application/pdf"), ("h", "http://h/a.pdf", "2002", "-", "application/pdf"), ("h", "http://h/a.pdf", "2000", "200", "application/zip"), ("h", "http://h/x.html", "2000", "200", "text/html"), ("i", "http://h/a.pdf", "2009", "200", "application/zip")]
    got = {(r.host, r.timestamp, r.wayback_url) for r in readers.captured_documents(spark.createDataFrame(rows, "host string, url string, timestamp string, status string, mime string")).collect()}
    assert got == {("h", "2002", "https://web.archive.org/web/2002id_/http://h/a.pdf"), ("i", "2009", "https://web.archive.org/web/2009id_/http://h/a.pdf")}


def test_a_database_that_is_not_there(spark):
    with pytest.warns(UserWarning, match="can't be reached"):
        got = readers.jdbc(spark, "jdbc:none://x", "t", "a%", "v", spark.createDataFrame([("ab",), ("b",), ("ab",)], "v string"))
    assert [r.v for r in got.collect()] == ["ab"]
