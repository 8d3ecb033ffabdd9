"""Each normaliser against a table of inputs and expected values, in one job for each."""

import uuid

import pytest
from pyspark.sql import functions as F

from fusionweft.functions import dates, people, places, skills, urls
from fusionweft.functions.core import py_round, py_round3, py_title
from fusionweft.operators.identity import uuid5_id


def run(spark, column, inputs, *names):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string").select("i", column(F.col("x")).alias("v")).orderBy("i")
    return [tuple(r["v"][n] for n in names) if names else r["v"] for r in df.collect()]


def test_names(spark):
    table = {
        "dana WHITE": ("Dana White", 1.0),
        "White, dana m.": ("Dana M. White", 0.9),
        "  lee   (they/them)  ": ("Lee", 1.0),
        "mary-jane o'neil": ("Mary-Jane O'Neil", 1.0),
        "d'angelo": ("D'Angelo", 1.0),
        "ludwig VAN der berg": ("Ludwig van der Berg", 1.0),
        "van berg": ("Van Berg", 1.0),
        "anna de-la-cruz": ("Anna de-la-Cruz", 1.0),
        "bo handles III": ("Bo Handles Iii", 1.0),
        "solo,": ("Solo,", 1.0),
        "(x)": (None, 0.0),
        "": (None, 0.0),
        None: (None, 0.0),
    }
    assert run(spark, people.name, table, "value", "conf") == list(table.values())


def test_emails(spark):
    table = {"MAILTO:A.b@C.Org": "a.b@c.org", "<x@y.de>": "x@y.de", "a@b@c.com": "a@b@c.com", "a..b@c.de": None, "@c.de": None, "a@": None, "a@nodot": None, "plain": None, " ": None, None: None, "j+t@gmail.com": "j+t@gmail.com"}
    assert [v for v, _ in run(spark, people.email, table, "value", "conf")] == list(table.values())
    got = spark.createDataFrame([("x A@b.org, a@B.org; mailto:c.d@e.co, q..r@s.de",)], "x string").select(people.emails_in(F.col("x"))).head()[0]
    assert got == ["a@b.org", "c.d@e.co"]
    assert run(spark, people.base_address, ["a.b+c+d@gmail.com", "a@gmail.com"]) == ["a.b@gmail.com", "a@gmail.com"]
    assert run(spark, people.is_alias, ["a+b@googlemail.com", "a+b@x.org", "a@gmail.com", None]) == [True, False, False, False]


def test_phones(spark):
    table = {"(415) 555-0101": ("+14155550101", 0.5), "+1-650-555-0202": ("+16505550202", 0.6), "0044 20 7946 0000": ("+442079460000", 0.6), "1 650 555 0202 ext. 9": ("+16505550202", 0.5), "650.555.0202x12": ("+16505550202", 0.5), "555-12": (None, 0.0), "2 650 555 0202": (None, 0.0), "+1234567890123456": (None, 0.0), "": (None, 0.0), None: (None, 0.0)}
    assert run(spark, people.phone, table, "value", "conf") == list(table.values())
    assert run(spark, lambda c: people.phone(c, "DE"), ["(415) 555-0101"], "value") == [(None,)]


def test_dates(spark):
    table = {
        "2020-1": ("2020-01", False, 1.0),
        "11/2019": ("2019-11", False, 1.0),
        " Sept 2020": (None, False, 0.0),
        "jan. 2020": ("2020-01", False, 1.0),
        "2020 March": ("2020-03", False, 0.95),
        "May '31": ("1931-05", False, 0.85),
        "May `30": ("2030-05", False, 0.85),
        "2051": (None, False, 0.0),
        "1950": ("1950", False, 0.8),
        "2020-13": (None, False, 0.0),
        "2020-01-02": (None, False, 0.0),
        "Till Date": (None, True, 1.0),
        "—": (None, True, 1.0),
        None: (None, False, 0.0),
    }
    assert run(spark, dates.date, table, "value", "current", "conf") == list(table.values())
    ranges = {"March 2019 - Present": ("2019-03", None, True, 1.0), "2018-01 – 2020-06": ("2018-01", "2020-06", False, 1.0), "2018 to 2020": ("2018", "2020", False, 0.8), "2018—now": ("2018", None, True, 0.8), "2018": ("2018", None, False, 0.8), None: (None, None, False, 0.0)}
    assert run(spark, dates.date_range, ranges, "start", "end", "current", "conf") == list(ranges.values())


def test_places(spark):
    table = {
        "san francisco, CA": ("San Francisco", "CA", "US", 0.95),
        "albany, New York": ("Albany", "NY", "US", 0.95),
        "london, uk": ("London", None, "GB", 0.9),
        "lyon, rhône": ("Lyon", "Rhône", None, 0.75),
        "austin, tx, USA": ("Austin", "TX", "US", 0.9),
        "Remote (EU)": (None, None, None, 0.7),
        "UAE": (None, None, "AE", 0.8),
        "st. john's": ("St. John'S", None, None, 0.5),
        " ": (None, None, None, 0.0),
        None: (None, None, None, 0.0),
    }
    assert run(spark, places.location, table, "city", "region", "country", "conf") == list(table.values())


def test_skills(spark):
    table = {"JS": ("JavaScript", 1.0, True), "Python 3.11": ("Python", 0.9, True), "node.js": ("Node.js", 1.0, True), "CI/CD": ("CI/CD", 1.0, True), "Spring Boot 3": ("Spring", 0.9, True), "basket weaving": ("Basket Weaving", 0.7, False), "!!": ("", 0.0, False), None: ("", 0.0, False)}
    assert run(spark, skills.skill, table, "value", "conf", "known") == list(table.values())
    assert run(spark, skills.skills_in, ["Used react.js, C++ and go; not django-x", "typescript"]) == [["React", "C++", "JavaScript", "Go"], ["TypeScript"]]


def test_urls(spark):
    table = {"HTTP://Example.COM/Path//": "https://example.com/Path", "linkedin.com/in/x": "https://linkedin.com/in/x", "https://a.b?q=1#f": "https://a.b?q=1#f", "a.b/?#": "https://a.b", "https:///x": None, "": None, None: None}
    assert [v for v, _ in run(spark, urls.url, table, "value", "conf")] == list(table.values())
    assert run(spark, urls.classify, ["https://LinkedIn.com/x", "http://github.com/a", "x", None]) == ["linkedin", "github", "other", "other"]
    assert run(spark, urls.github_user, ["https://www.github.com/a-b/repo", "https://github.com/orgs/x", "https://x.org/a"]) == ["a-b", None, None]


def test_python_compatible_helpers(spark):
    values = [k / 10000 for k in range(60, 10000, 7)] + [0.2125, 0.2975, 0.4335, 0.5525, 0.5625, 0.6375, 0.8075, 1.0, 0.0]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double").select("i", py_round3(F.col("x")).alias("v")).orderBy("i").collect()
    assert [r["v"] for r in got] == [round(v, 3) for v in values]
    values = [2.675, 9.0005, 0.5, 1.5, 2.5, -2.675, -0.4, 1e300, 123456789.125, 5e-324, 0.1 + 0.2, 1.005, 2.0**53 + 2] + [k / 1000 + 0.0005 for k in range(0, 20000, 37)]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    for places in (0, 1, 2, 3, 5, 9):
        got = frame.select("i", py_round(F.col("x"), places).alias("v")).orderBy("i").collect()
        assert [str(r["v"]) for r in got] == [str(round(v, places)) for v in values]
    texts = ["o'neil st. john's", "C++17 3d", "são paulo", ""]
    assert run(spark, py_title, texts) == [t.title() for t in texts]
    assert run(spark, uuid5_id, ["jo", "é:+1"]) == [uuid.uuid5(uuid.NAMESPACE_DNS, k).hex[:16] for k in ("jo", "é:+1")]


@pytest.mark.parametrize("bad", ["missing.json", "bad.json"])
def test_taxonomy_file_may_be_missing_or_damaged(tmp_path, bad):
    (tmp_path / "bad.json").write_text("{")
    assert skills.load_taxonomy(tmp_path / bad) == {}
    assert len(skills.taxonomy()) == 123
