"""Readers.  Each attaches the place a row came from, as order decides ties.

A missing path gives an empty frame of the schema, a body that isn't what it
should be gives no rows
(``quarantine`` names those): extracts of one source must not stop the others."""

from __future__ import annotations

import re
import warnings

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PROJECT = "lon double, lat double, name string, jurisdiction string, source string, status string, type string, category string, proponent string, registry_url string, description string, municipality string, ord long"
INVENTORY = "source string, source_label string, fetched string, projects array<struct<ext_id:string,name:string,proponent:string,province:string,sector:string,value_cad:double,coords:array<double>,url:string,status:string>>"
CATALOGUE = "project string, docs array<struct<title:string,category:string,date:string,url:string,archive_url:string,captured:string,fallback_url:string,source:string>>"
MANIFEST = "map<string,struct<jur:string,project:string,title:string,key:string,archive_url:string,bytes:bigint,sha256:string,content_type:string,kind:string,file_url:string,fetched_at:string,fails:int,error:string,doc_date:string,doc_ref:string>>"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return found is not None and len(found) > 0


def prefer(spark: SparkSession, *paths: str) -> str | None:
    """The first path that is there."""
    return next((p for p in paths if exists(spark, p)), None)


def empty(spark: SparkSession, schema: str | StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of JSON arrays or objects, gzip or not, with their file."""
    if not exists(spark, path):
        return empty(spark, f"{schema}, _file string")
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    return rows.withColumn("_file", F.col("_metadata.file_path"))


def quarantine(spark: SparkSession, path: str) -> DataFrame:
    """What ``json_rows`` leaves out: file and body of everything that is no JSON."""
    if not exists(spark, path):
        return empty(spark, "_file string, body string")
    rows = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("_file"), F.col("value").alias("body"))
    return rows.where(F.try_parse_json("body").isNull())


def nested(spark: SparkSession, path: str, field: str, element: str) -> DataFrame:
    """Elements of an array that is a field of a file's first object: [{field: [...]}]."""
    rows = json_rows(spark, path, f"{field} array<struct<{element}>>")
    first = rows.select("_file", F.col(field), F.row_number().over(Window.partitionBy("_file").orderBy(F.monotonically_increasing_id())).alias("n")).where("n = 1")
    return first.select("_file", F.posexplode(field).alias("pos", "x")).select("_file", "pos", "x.*")


def geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Features: lon, lat (null without a sound point), the properties named and
    pos.  A MultiPoint counts by its first point."""
    schema = f"features array<struct<geometry:struct<type:string,coordinates:string>,properties:struct<{properties}>>>"
    f = json_rows(spark, path, schema).select("_file", F.posexplode("features").alias("pos", "f"))
    coordinates = F.col("f.geometry.coordinates")
    flat = F.when(F.col("f.geometry.type") == "MultiPoint", F.regexp_extract(coordinates, r"^\[\s*(\[[^\]]*\])", 1)).otherwise(coordinates)
    point = F.from_json(flat, "array<double>")
    return f.select("_file", "pos", F.try_element_at(point, F.lit(1)).alias("lon"), F.try_element_at(point, F.lit(2)).alias("lat"), "f.properties.*")


def url_map(spark: SparkSession, path: str, value: str = MANIFEST) -> DataFrame:
    """An object keyed by url, one row a key."""
    if not exists(spark, path):
        return empty(spark, "url string")
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.explode(F.from_json("value", value)).alias("url", "v")).select("url", "v.*")


def inventories(spark: SparkSession, path: str) -> DataFrame:
    rows = json_rows(spark, path, INVENTORY).select("source", "_file", F.posexplode("projects").alias("pos", "p"))
    return rows.select("source", "_file", "pos", "p.*")


def catalogues(spark: SparkSession, path: str) -> DataFrame:
    """Documents of catalogue files; jurisdiction and catalogue from the path."""
    rows = json_rows(spark, path, CATALOGUE).select("project", "_file", F.posexplode("docs").alias("pos", "d"))
    part = lambda i: F.element_at(F.split("_file", "/"), i)
    return rows.select(part(-2).alias("jur"), F.regexp_replace(part(-1), r"\.json(\.gz)?$", "").alias("catalogue_id"), "project", "pos", "d.*")


def table_rows(html: Column, least: int) -> Column:
    """Cells of an HTML table's rows, tags gone, of rows with enough cells; cells
    may lack their closing tags."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)(?=</tr>|<tr[ >]|</table>|\z)"), 1)
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"(&nbsp;|\s)+", " "))
    cells = F.transform(rows, lambda r: F.transform(F.slice(F.split(r, r"(?i)<td[^>]*>"), 2, 1000), clean))
    return F.filter(cells, lambda c: F.size(c) >= least)


def anchors(html: Column) -> Column:
    """href and label (200 letters at most) of links that lead somewhere."""
    pattern = F.lit(r"(?is)<a\s[^>]*?href\s*=\s*[\"']([^\"'#][^\"']*)[\"'][^>]*>(.*?)</a>")
    pairs = F.arrays_zip(F.regexp_extract_all(html, pattern, 1).alias("href"), F.regexp_extract_all(html, pattern, 2).alias("label"))
    pairs = F.filter(pairs, lambda p: ~p["href"].rlike(r"(?i)^\s*(mailto|tel|javascript):"))
    return F.transform(pairs, lambda p: F.struct(F.trim(p["href"]).alias("href"), F.substring(F.trim(F.regexp_replace(F.regexp_replace(p["label"], "<[^>]*>", " "), r"\s+", " ")), 1, 200).alias("label")))


def absolute(href: Column, base: Column) -> Column:
    """An href against a page's url, without fragment: absolute, scheme-relative,
    root-relative and simple relative forms."""
    root, scheme = F.regexp_extract(base, r"^[A-Za-z]+://[^/?#]*", 0), F.regexp_extract(base, r"^[A-Za-z]+:", 0)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"(?<![:/])/[^/]*$", "")
    full = F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(scheme, href)).when(href.startswith("/"), F.concat(root, href)).when(href.startswith("?"), F.concat(F.regexp_replace(base, r"[?#].*$", ""), href)).otherwise(F.concat(folder, F.lit("/"), href))
    return F.regexp_replace(full, "#.*$", "")


def sections(html: Column, wanted: list[str]) -> Column:
    """heading and body of the wanted h2 sections."""
    parts = F.slice(F.split(html, r"(?i)<h2[^>]*>"), 2, 100000)
    pair = F.transform(parts, lambda p: F.struct(F.trim(F.regexp_replace(F.split(p, r"(?i)</h2>")[0], "<[^>]*>", "")).alias("heading"), F.try_element_at(F.split(p, r"(?i)</h2>"), F.lit(2)).alias("body")))
    return F.filter(pair, lambda p: p["heading"].isin(wanted))


def sitemap(xml: Column) -> Column:
    return F.regexp_extract_all(xml, F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), 1)


def capture_index(rows: Column) -> Column:
    """A capture index (array of arrays, names first): url, timestamp, status and type of
    captures that were there."""
    parsed = F.slice(F.from_json(rows, "array<array<string>>"), 2, 1 << 30)
    named = F.transform(parsed, lambda r: F.struct(r[0].alias("url"), r[1].alias("timestamp"), r[2].alias("status"), r[3].alias("mime")))
    return F.filter(named, lambda r: r["status"].isin("200", "-"))


# Types of documents that are sought among captures.
DOCUMENT_TYPES = ("application/pdf", "application/msword", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/zip")


def captured_documents(captures: DataFrame) -> DataFrame:
    """Of captures (host, url, timestamp, status, mime), the documents: the first capture
    of each url of a host that was there, by type in the order of ``DOCUMENT_TYPES`` and
    then by time, with the address of the capture's own bytes."""
    there = captures.where(F.col("mime").isin(*DOCUMENT_TYPES) & F.col("status").isin("200", "-"))
    order = F.struct(F.array_position(F.array(*map(F.lit, DOCUMENT_TYPES)), F.col("mime")).alias("kind"), "timestamp")
    first = there.groupBy("host", "url").agg(F.min_by(F.struct("timestamp", "status", "mime"), order).alias("x"))
    return first.select("host", "url", "x.*", F.concat(F.lit("https://web.archive.org/web/"), F.col("x.timestamp"), F.lit("id_/"), F.col("url")).alias("wayback_url"))


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path) if exists(spark, path) else empty(spark, schema)


def corpus(spark: SparkSession, index_path: str, text_path: str) -> DataFrame:
    """An index's documents with their texts (doc_id.txt or .txt.gz)."""
    ix = json_rows(spark, index_path, "doc_id string, url string, title string, category string, project string, project_id string").drop("_file")
    if not exists(spark, text_path):
        return empty(spark, "doc_id string, url string, title string, category string, project string, project_id string, body string")
    body = spark.read.option("wholetext", True).text(text_path).select(F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.txt(\.gz)?$", "").alias("doc_id"), F.col("value").alias("body"))
    return ix.join(body, "doc_id")


def listing(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes and time of files, without their contents."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def whole_pdfs(files: DataFrame, least: int = 1000) -> DataFrame:
    """Of binaryFile rows, those that are whole PDFs."""
    head, tail = F.substring("content", 1, 5), F.right(F.decode("content", "ISO-8859-1"), F.lit(1024))
    return files.where((F.col("length") >= least) & (F.decode(head, "ISO-8859-1") == "%PDF-") & tail.contains("%%EOF"))


def jdbc(spark: SparkSession, url: str, table: str, like: str, column: str, fallback: DataFrame) -> DataFrame:
    """Distinct values like a pattern, from a database, or else from a fallback: where the
    database can't be reached or has no driver here, which a warning says.  A table that
    isn't there, or any other fault, is raised."""
    try:
        rows = spark.read.format("jdbc").options(url=url, dbtable=table).load()
    except Exception as e:
        if not re.search("No suitable driver|Connection|connect|Communications link|ClassNotFound", str(e)):
            raise
        warnings.warn(f"{url} can't be reached, its fallback is read", stacklevel=2)
        rows = fallback
    return rows.where(F.col(column).like(like)).select(column).distinct().orderBy(column)
