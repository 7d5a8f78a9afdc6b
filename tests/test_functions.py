import pytest
from pyspark.sql import functions as F

from dossier.functions import geo, rules, text
from dossier.operators import search


def value(spark, column, **given):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in given.items()]) if given else spark.range(1)
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("kind", "want"),
    [("report on a trail", "other"), ("mines", "other"), ("the old mine", "mining"), ("port", "transport"), ("manufacturing hall", "industrial"), ("Parc éolien", "wind"), ("Wind farm", "wind"), (None, "other")],
)
def test_category(spark, kind, want):
    assert value(spark, rules.category(F.lit(kind))) == want


def test_category_falls_back_to_the_name(spark):
    assert value(spark, rules.category(F.lit("Comprehensive study"), F.lit("Ring road"), F.lit(None))) == "transport"


@pytest.mark.parametrize(("title", "want"), [("Draft Environmental Study Report", "ESR_draft"), ("Notice of Completion", "notice_of_completion"), ("Terms of Reference", "terms_of_reference"), ("Hello", "other")])
def test_document_types(spark, title, want):
    assert value(spark, rules.first_match(F.lit(title), rules.DOC_TYPES)) == want


def test_keywords_take_the_first_of_equals(spark):
    assert value(spark, rules.best_keywords(F.lit("fish and bog"), rules.DISCIPLINE_RULES, "other")) == "fish_fish_habitat"
    assert value(spark, rules.best_keywords(F.lit("nothing here"), rules.DISCIPLINE_RULES, "other")) == "other"
    assert value(spark, rules.first_substring(F.lit("Fish and Fish Habitat"), rules.SECTION_RULES)) == "fish_fish_habitat"


def test_fired():
    assert rules.fired("wind", ["wetland"]) == sorted({"indigenous_rights_tluse", "accidents_malfunctions", "archaeology_heritage", "wildlife_birds", "noise_vibration", "closure_postclosure", "wetlands", "surface_water"})
    assert "other" not in rules.fired("wind", full=True)


@pytest.mark.parametrize(("name", "want"), [("Côté Doré", "cote dore"), (None, None), (" ÀB ", "ab")])
def test_fold(spark, name, want):
    assert spark.createDataFrame([(name,)], "n string").select(text.fold("n").alias("x")).first().x == want


@pytest.mark.parametrize(
    ("column", "want"),
    [
        (lambda: text.pretty_date(F.lit("2013-04-15")), "2013-Apr-15"),
        (lambda: text.pretty_date(F.lit("2013-4-15")), None),
        (lambda: text.parse_date(F.lit("April 5, 2013")), "2013-04-05"),
        (lambda: text.parse_date(F.lit("Smarch 5, 2013")), None),
        (lambda: text.municipality(F.lit("Approximately 185 kilometres northeast of Cochrane")), "Cochrane"),
        (lambda: text.municipality(F.lit("Kincardine to Milton")), "Kincardine"),
        (lambda: text.municipality(F.lit("City of Thunder Bay")), "Thunder Bay"),
        (lambda: text.norm_url(F.lit("https://www.Example.org/a%20b/?q=1+2#x")), "example.org/a b?q=1+2"),
        (lambda: text.stem(F.lit("https://a.b/x/Limerock-EA_Pages.pdf")), "Limerock-EA Pages"),
        (lambda: text.stem(F.lit("https://a.b/download")), None),
        (lambda: text.registry_id(F.lit("https://a/document/123")), "doc 123"),
        (lambda: text.registry_id(F.lit("https://bape/x?id=0045")), "BAPE 45"),
        (lambda: text.captured(F.lit("20200131")), "captured 2020-01-31"),
        (lambda: text.slug(F.lit("A b--C!")), "a-b-c"),
        (lambda: text.safe(F.lit("///")), "file"),
        (lambda: text.python_title(F.lit("o'brien mary-ann")), "O'Brien Mary-Ann"),
        (lambda: text.norm_company(F.lit("Acme & Sons (Canada) Ltd.")), "acme and sons"),
        (lambda: text.make_id(F.lit("Nova Scotia (NSECC)"), F.lit("x")), "ns-" + __import__("hashlib").md5(b"Nova Scotia (NSECC)||x").hexdigest()[:10]),
        (lambda: text.truthy(F.lit(""), F.lit("a")), "a"),
        (lambda: text.keeps_digits(F.lit("within 30 m"), F.lit("at 30 m of")), True),
        (lambda: text.keeps_digits(F.lit("within 31 m"), F.lit("at 30 m of")), False),
    ],
)
def test_normalisers(spark, column, want):
    assert value(spark, column()) == want


def test_tokens(spark):
    assert sorted(value(spark, text.tokens(F.lit("the west detour project 2 of west")))) == ["detour", "west"]
    assert value(spark, text.ngrams(F.split(F.lit("a b c"), " "), 2)) == ["a b", "b c"]
    assert value(spark, text.ngrams(F.split(F.lit("a"), " "), 2)) == []


def test_instrument(spark):
    page = "AMENDMENT TO RENEWABLE ENERGY APPROVAL NUMBER 1234-ABC123 Issue Date: May 21, 2014 amended Approval No. 9999-ZZZ999, issued on April 15, 2013"
    row = spark.range(1).select(*[c.alias(k) for k, c in text.instrument(F.lit(page)).items()]).first()
    assert (row.kind, row.rea_number, row.issue_date, row.amends_number, row.amends_date) == ("amendment", "1234-ABC123", "2014-05-21", "9999-ZZZ999", "2013-04-15")


def test_geo(spark):
    assert value(spark, geo.haversine_km(F.lit(-75.7), F.lit(45.4), F.lit(-79.4), F.lit(43.7))) == pytest.approx(350.6, abs=3)
    east, north = geo.utm17(F.lit(-79.3871), F.lit(43.6426))
    assert value(spark, east) == pytest.approx(630084, abs=15)
    assert value(spark, north) == pytest.approx(4833438, abs=15)


@pytest.mark.parametrize(("word", "want"), [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("monitoring", "monitor"), ("conditional", "condit"), ("sky", "sky"), ("happy", "happi")])
def test_porter(word, want):
    assert search.stem(word) == want
