"""Writers that join or claim at commit, and workbooks."""

import hashlib
import json
import os
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.sources import commits, xlsx


def test_feature_collection_is_one_file(spark, tmp_path):
    df = spark.range(500).select((500 - F.col("id")).alias("ord"), F.when(F.col("id") % 3 > 0, F.col("id") / 2).alias("lon"), F.lit(45.5).alias("lat"), F.concat(F.lit('n"é'), "id").alias("name"), F.lit(None).cast("string").alias("no"))
    path = str(tmp_path / "all.geojson")
    for _ in range(2):  # again over the first
        commits.feature_collection(df.repartition(5), path)
    got = json.load(open(path))
    assert [f["properties"] for f in got["features"]] == [{"name": f'n"é{499 - i}'} for i in range(500)]
    assert got["features"][0]["geometry"] == {"type": "Point", "coordinates": [249.5, 45.5]} and "geometry" not in got["features"][1]
    assert os.listdir(tmp_path) == ["all.geojson"]
    commits.feature_collection(df.where("false"), str(tmp_path / "none.geojson"))
    assert json.load(open(tmp_path / "none.geojson"))["features"] == []


def test_raster_reads_back(spark, tmp_path):
    rng = np.random.default_rng(3)
    want = rng.random((37, 23)).astype(np.float32)
    want[5] = np.nan
    rows = [(r, c, float(want[r, c])) for r in range(37) for c in range(23) if r != 5] + [(99, 0, 1.0), (0, -1, 1.0)]
    commits.raster(spark.createDataFrame(rows, "row int, col int, cost double").repartition(4), str(tmp_path / "cost.npy"), 37, 23)
    np.testing.assert_array_equal(np.load(tmp_path / "cost.npy"), want)


def objects(spark, n, bad=None):
    @F.udf("binary")
    def data(i):
        if i == bad:
            raise RuntimeError("the store is gone")
        return f"body {i}".encode()

    return spark.range(n).repartition(3).select(F.concat(F.lit("http://x/"), "id").alias("url"), F.concat(F.lit("on/p/"), "id", F.lit(".pdf")).alias("key"), data("id").alias("data"))


def test_claims_come_after_uploads(spark, tmp_path):
    path, manifest = str(tmp_path / "bucket"), str(tmp_path / "manifest")
    commits.archive(objects(spark, 20), path, manifest)
    rows = spark.read.json(manifest).collect()
    assert len(rows) == 20
    for r in rows:
        body = open(f"{path}/{r.key}", "rb").read()
        assert (len(body), hashlib.sha256(body).hexdigest()) == (r.bytes, r.sha256)
    assert sorted(os.listdir(path)) == ["on"]


def test_a_failed_task_claims_nothing(spark, tmp_path):
    path, manifest = str(tmp_path / "bucket"), str(tmp_path / "manifest")
    with pytest.raises(Exception, match="the store is gone"):
        commits.archive(objects(spark, 20, bad=19), path, manifest)
    assert not os.path.exists(manifest)
    assert not [f for _, _, files in os.walk(path) for f in files]


MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def workbook(path, sheets, active=0, strings=()):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><bookViews><workbookView activeTab="{active}"/></bookViews><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, (n, _) in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        if strings:
            z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>" + "".join(f"<si>{s}</si>" for s in strings) + "</sst>")
        for i, (_, body) in enumerate(sheets):
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {MAIN}><sheetData>{body}</sheetData></worksheet>")


def test_workbooks(spark, tmp_path):
    head = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="D1" t="inlineStr"><is><t>note</t></is></c></row>'
    body = '<row r="3"><c r="A3" t="s"><v>2</v></c><c r="B3"><v>1978</v></c><c r="D3" t="b"><v>1</v></c><c r="F3"><v>9</v></c></row><row r="4"/><row r="5"><c r="B5" t="str"><f>A1</f><v>x &amp; y</v></c></row>'
    many = "".join(f'<row><c><v>{i}</v></c></row>' for i in range(2500))
    workbook(tmp_path / "a.xlsx", [("First", many), ("Seed", head + body)], active=1, strings=["<t>name</t>", "<r><t>ye</t></r><r><t>ar</t></r><rPh><t>no</t></rPh>", "<t>Ünï</t>"])
    (tmp_path / "broken.xlsx").write_bytes(b"no zip")
    got = xlsx.table(spark, str(tmp_path))
    assert got.columns == ["_file", "_row", "name", "year", "note"]
    assert [tuple(r)[1:] for r in got.orderBy("_row").collect()] == [(3, "Ünï", "1978", "true"), (5, None, "x & y", None)]
    first = xlsx.cells(spark, str(tmp_path), "First")
    assert first.count() == 2500 and first.agg(F.max("row")).first()[0] == 2500
    assert xlsx.table(spark, str(tmp_path), "none").count() == 0 and xlsx.column("AB12") == 27
