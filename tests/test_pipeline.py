"""Sources, merging, scoring, projecting and validating, end to end on small invented files."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fusionweft.operators import facts as fact_rows
from fusionweft.plans.config import ConfigError, load_config, parse_config
from fusionweft.plans.pipeline import Pipeline, candidates, view
from fusionweft.sources.base import Source
from fusionweft.sources.delimited import DelimitedSource
from fusionweft.sources.documents import DocumentSource
from fusionweft.sources.rest import Fetcher, ProfileSource, fetched
from fusionweft.streaming.runs import latest, merge_batches

AT = datetime(2024, 1, 2, 3, 4, 5)
CSV = """﻿Name,Email,PHONE,Employer,Role,City,LinkedIn,GitHub,Tech_Stack,Bio
Rosa Diaz,rosa@example.org,(415) 555-0199,Initech,Engineer,"Austin, TX",https://linkedin.com/in/rosa,,"py, React; Docker","Says ""hi"",
on two lines"
"DIAZ, ROSA",ROSA@example.org,,Initech,engineer,remote,,,,
,broken,555,,,,,,,
Short Row,short@example.org

Kim Park,kim+jobs@gmail.com,,,,,,,,
"""
DOCS = {
    "candidates": [
        {"candidateName": "Rosa Diaz", "email": None, "emailAddress": "rosa@example.org", "mobile": "+1 415 555 0199", "location": "Austin, TX", "linkedinUrl": "linkedin.com/in/rosa/", "website": "https://rosa.example", "skillSet": ["Python", " ", "Go"], "workHistory": [{"company": "Initech", "title": "Engineer", "startDate": "Jan 2020", "endDate": "Present", "current": True}, {"employer": "Old", "job_title": "Dev", "start": "2018", "end": "2019-12", "current": False}], "educationHistory": [{"school": "State U", "major": "Math", "graduationYear": 2016}]},
        "no object",
        {"fullName": "Kim Park", "email": "kim@gmail.com", "technologies": "rust|go", "title": "CTO"},
        {"email": "bad"},
    ]
}


@pytest.fixture(scope="module")
def sources(tmp_path_factory):
    folder = tmp_path_factory.mktemp("in")
    (folder / "people.csv").write_text(CSV, encoding="utf-8")
    (folder / "docs.json").write_text(json.dumps(DOCS))
    return [DelimitedSource(f"{folder}/people.csv"), DocumentSource(f"{folder}/docs.json")]


@pytest.fixture(scope="module")
def merged(spark, sources):
    raw = sources[0].extract(spark, 0, AT).unionByName(sources[1].extract(spark, 1, AT))
    return candidates(raw).cache()


def by_name(rows):
    return {r["full_name"]: r for r in rows}


def test_delimited_rows(spark, sources):
    rows = sources[0].extract(spark, 0, AT).orderBy("row_idx").collect()
    assert [r["full_name"] for r in rows] == ["Rosa Diaz", "DIAZ, ROSA", "Short Row", "Kim Park"]
    assert rows[0]["skills_raw"] == ["py", "React", "Docker"] and "\n" in rows[0]["headline"] and '"hi"' in rows[0]["headline"]
    assert rows[0]["experience"][0].asDict() == {"company": "Initech", "title": "Engineer", "start": None, "end": None, "is_current": True, "summary": None}
    assert rows[2]["emails"] == ["short@example.org"] and rows[2]["phones"] == []
    assert [x["type"] for x in rows[0]["links"]] == ["linkedin"] and rows[0]["source_id"] == "csv:people.csv"


@pytest.mark.parametrize(("text", "count"), [('[{"name": "A"}]', 1), ('{"data": [{"name": "A"}, 3]}', 1), ('{"data": {"name": "A"}}', 1), ('{"name": "A"}', 1), ("{broken", 0), ("3", 0), ("", 0), ('{"candidates": []}', 0)])
def test_document_roots(spark, tmp_path, text, count):
    (tmp_path / "d.json").write_text(text)
    assert DocumentSource(f"{tmp_path}/d.json").extract(spark, 0, AT).count() == count
    assert DocumentSource(f"{tmp_path}/none.json").extract(spark, 0, AT).count() == 0
    assert DelimitedSource(f"{tmp_path}/none.csv").extract(spark, 0, AT).count() == 0


def test_document_fields(spark, sources):
    rosa, kim = sources[1].extract(spark, 1, AT).orderBy("row_idx").collect()
    assert rosa["emails"] == ["rosa@example.org"] and rosa["skills_raw"] == ["Python", "Go"]
    assert [(e["company"], e["title"], e["start"], e["is_current"]) for e in rosa["experience"]] == [("Initech", "Engineer", "Jan 2020", True), ("Old", "Dev", "2018", False)]
    assert rosa["education"][0].asDict() == {"institution": "State U", "degree": None, "field": "Math", "end_year": "2016"}
    assert kim["skills_raw"] == ["rust", "go"] and kim["experience"][0]["title"] == "CTO"


def test_merge(merged):
    people = by_name(merged.collect())
    rosa, kim = people["Rosa Diaz"], people["Kim Park"]
    assert set(people) == {"Rosa Diaz", "Kim Park", "Short Row"}
    assert rosa["sources_ingested"] == ["csv:people.csv", "csv:people.csv", "ats_json:docs.json"]
    assert rosa["emails"] == ["rosa@example.org"] and rosa["phones"] == ["+14155550199"]
    assert kim["emails"] == ["kim+jobs@gmail.com", "kim@gmail.com"]
    assert rosa["location"].asDict() == {"city": "Austin", "region": "TX", "country": "US", "raw": "Austin, TX"}
    assert [(s["name"], s["confidence"], s["sources"]) for s in rosa["skills"]] == [("Python", 0.88, ["csv:people.csv", "ats_json:docs.json"]), ("Go", 0.88, ["ats_json:docs.json"]), ("React", 0.85, ["csv:people.csv"]), ("Docker", 0.85, ["csv:people.csv"])]
    assert [(e["company"], e["start"], e["end"], e["is_current"], e["source"]) for e in rosa["experience"]] == [("Initech", "2020-01", None, True, "ats_json:docs.json"), ("Old", "2018", "2019-12", False, "ats_json:docs.json"), ("Initech", None, None, True, "csv:people.csv")]
    assert rosa["links"].asDict() == {"linkedin": "https://linkedin.com/in/rosa", "github": None, "portfolio": "https://rosa.example", "other": ["https://linkedin.com/in/rosa"]}
    assert rosa["headline"].startswith("Says")


def test_provenance_and_conflicts(merged):
    rows = fact_rows.facts(merged)
    names = [(r["source"], r["raw_value"], r["confidence"], r["conflict"], r["conflict_resolution"]) for r in fact_rows.for_field(rows, "full_name").where("normalized_value = 'Rosa Diaz'").orderBy("pos").collect()]
    assert names == [("csv:people.csv", "Rosa Diaz", 0.85, True, "source_priority:ats_json:docs.json_wins"), ("csv:people.csv", "DIAZ, ROSA", 0.765, True, "source_priority:ats_json:docs.json_wins"), ("ats_json:docs.json", "Rosa Diaz", 0.88, False, None)]
    assert {r["field"] for r in fact_rows.low_confidence(rows).collect()} == {"headline", "phones"}
    assert fact_rows.conflicts(rows).count() == 4  # two names of Rosa's, one of Kim's, one location
    assert fact_rows.for_source(rows, "ats_json:docs.json").count() == 4


def test_order_of_rows_does_not_matter(spark, sources, merged):
    raw = sources[0].extract(spark, 0, AT).unionByName(sources[1].extract(spark, 1, AT))
    again = candidates(raw.orderBy(F.rand(3)).repartition(3))
    key = lambda df: sorted(json.dumps(r.asDict(True), default=str, sort_keys=True) for r in df.collect())
    assert key(again) == key(merged)


def test_one_exchange_for_each_merge(spark, sources):
    raw = spark.createDataFrame(sources[0].extract(spark, 0, AT).collect(), sources[0].extract(spark, 0, AT).schema)
    plan = candidates(raw)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_scores(merged):
    got = {r["full_name"]: r["overall_confidence"] for r in merged.collect()}
    name = min((0.85 + 0.765 + 0.88) / 3 * 1.05, 1)
    rosa = 0.85 * 0.25 + name * 0.2 + 0.425 * 0.1 + (0.88 + 0.88 + 0.85 + 0.85) / 4 * 0.2 + 0.7 * 0.15 + (0.808 + 0.836) / 2 * 0.05 + 0.595 * 0.05
    assert got["Rosa Diaz"] == pytest.approx(round(rosa, 3), abs=1e-9)
    nameless = {k: v for k, v in got.items() if k is None}
    assert not nameless


def test_default_view_and_envelope(spark, sources):
    out = Pipeline(sources).run(spark, AT).to_dict()
    assert (out["candidates_total"], out["candidates_failed"], out["sources_attempted"]) == (3, 0, 2)
    first = out["candidates"][0]
    assert list(first) == ["candidate_id", "full_name", "emails", "phones", "location", "links", "headline", "years_experience", "skills", "experience", "education", "overall_confidence", "provenance", "sources_ingested", "pipeline_version", "created_at"]
    assert [c["full_name"] for c in out["candidates"]] == ["Rosa Diaz", "Short Row", "Kim Park"]
    assert first["location"] == {"city": "Austin", "region": "TX", "country": "US"} and first["created_at"] == "2024-01-02T03:04:05Z"
    assert "source" not in first["experience"][0] and first["education"][0]["field"] == "Math"


FIELDS = [
    {"source": "full_name", "target": "who.name", "required": True},
    {"source": "emails[0]", "target": "who.mail", "transform": "upper"},
    {"source": "phones", "target": "tel", "transform": "join:; "},
    {"source": "links.github", "target": "code"},
    {"source": "skills", "target": "good", "filter": "confidence >= 0.86", "transform": "pluck:name"},
    {"source": "experience[*].company", "target": "firms"},
    {"source": "experience", "target": "now", "filter": "is_current = true", "transform": "count"},
    {"source": "overall_confidence", "target": "band", "transform": "map_range:[0,1]=Some,[1,]=Sure"},
]


def test_custom_view(spark, merged):
    config = parse_config({"fields": FIELDS, "provenance": False, "missing_value_policy": "omit"})
    got = {r["who"]["name"]: json.loads(r["_json"]) for r in view(merged, config, 2024).collect()}
    rosa, short = got["Rosa Diaz"], got["Short Row"]
    assert rosa["who"] == {"name": "Rosa Diaz", "mail": "ROSA@EXAMPLE.ORG"} and rosa["tel"] == "+14155550199"
    assert rosa["good"] == ["Python", "Go"] and rosa["firms"] == ["Initech", "Old", "Initech"] and rosa["now"] == 2 and rosa["band"] == "Some"
    assert set(short) == {"candidate_id", "who", "tel", "now", "band", "overall_confidence"} and short["tel"] == ""


def test_observed_compatibility(spark, merged):
    config = parse_config({"fields": FIELDS[4:5] + FIELDS[7:], "provenance": False, "confidence": False})
    rows = view(merged, config, 2024, "observed").collect()
    assert all(r["good"] is None for r in rows) and all(r["band"].startswith("0.") for r in rows)


def test_required_fields_fail_a_candidate(spark, sources):
    config = parse_config({"fields": [{"source": "location.city", "target": "city", "required": True}]})
    out = Pipeline(sources, config).run(spark, AT).to_dict()
    assert (out["candidates_total"], out["candidates_failed"], len(out["candidates"])) == (3, 2, 1)


def test_validation_never_drops(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"name": "A", "email": "a@b@c.de", "education": [{"school": "U", "endYear": 2090}], "jobs": [{"company": "C", "start": "2020-01", "end": "2019-01"}]}]))
    out = Pipeline([DocumentSource(f"{tmp_path}/a.json")]).run(spark, AT).to_dict()
    (only,) = out["candidates"]
    assert out["validation_summary"]["errors"] == {only["candidate_id"]: ["[emails.0] has invalid format"]}
    assert out["validation_summary"]["warnings"] == {only["candidate_id"]: ["Invalid date range for C: start=2020-01 > end=2019-01", "Suspicious future education year 2090 at U"]}


def test_a_failing_source_stops_nobody(spark, sources):
    class Broken(Source):
        source_type = "broken"

        def extract(self, spark, src_idx, at):
            raise OSError("gone")

    result = Pipeline([Broken(), sources[1]]).run(spark, AT)
    assert result.source_failures == {"0:broken": "gone"} and result.to_dict()["candidates_total"] == 2
    assert Pipeline([]).run(spark, AT).to_dict()["candidates"] == []


def test_landed_profiles(spark):
    profiles = spark.createDataFrame([("ro", 200, "Rosa", "R@X.org", "dev, r@x.org or w@y.de", "@Initech", "rosa.example/", "Austin, TX"), ("no", 404, None, None, None, None, None, None), ("kim", 200, "Kim", None, None, "", "", None)], "login string, status int, name string, email string, bio string, company string, blog string, location string")
    repos = spark.createDataFrame([("ro", 0, "Go", 5, False), ("ro", 1, "Rust", 9, False), ("ro", 2, "Go", 5, False), ("ro", 3, "C", 99, True), ("ro", 4, None, 99, False)], "login string, pos int, language string, size bigint, fork boolean")
    rows = {r["full_name"]: r for r in ProfileSource(profiles, repos).extract(spark, 2, AT).collect()}
    rosa = rows["Rosa"]
    assert set(rows) == {"Rosa", "Kim"} and rosa["emails"] == ["r@x.org", "w@y.de"] and rosa["skills_raw"] == ["Go", "Rust"]
    assert rosa["experience"][0]["company"] == "Initech" and [x["url"] for x in rosa["links"]] == ["https://github.com/ro", "https://rosa.example"]
    assert rows["Kim"]["warnings"] == ["no_languages_found"] and rows["Kim"]["emails"] == []


def test_fetcher_retries():
    class Answer:
        def __init__(self, code, body=None, headers=None):
            self.status_code, self.headers, self.json = code, headers or {}, lambda: body

    answers, waits = [OSError(), Answer(429, headers={"Retry-After": "7"}), Answer(200, {"name": "A"}), Answer(500)], []

    def get(url, timeout):
        got = answers.pop(0)
        if isinstance(got, Exception):
            raise got
        return got

    profile, repos = Fetcher(get, wait=waits.append).fetch("a")
    assert profile["name"] == "A" and repos == [] and waits == [1, 7.0]


@pytest.mark.parametrize("bad", [{"missing_value_policy": "drop"}, {"fields": ["x"]}, {"fields": [{"target": "x"}]}, {"fields": [{"source": "x", "transform": "shout"}]}, {"fields": [{"source": "x", "missing_policy": "maybe"}]}])
def test_bad_configurations(bad):
    with pytest.raises(ConfigError):
        parse_config(bad)


def test_configuration_files(tmp_path):
    (tmp_path / "c.yaml").write_text("missing_value_policy: null\nfields: []\n")
    assert load_config(tmp_path / "c.yaml").whole and load_config(tmp_path / "c.yaml").missing_value_policy == "null"
    with pytest.raises(ConfigError):
        load_config(tmp_path / "none.yaml")


def test_stream_of_batches(spark, sources, tmp_path):
    for source in (sources[0], sources[1]):  # two files, two batches
        source.extract(spark, 0, AT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/raw")
    schema = spark.read.parquet(f"{tmp_path}/raw").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/raw")
    sink = lambda df, n: df.select("candidate_id", "_json", F.lit(n).alias("batch")).write.mode("overwrite").parquet(f"{tmp_path}/out/n={n}")
    query = merge_batches(stream, f"{tmp_path}/facts", sink).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {json.loads(r["_json"])["full_name"]: json.loads(r["_json"]) for r in latest(spark.read.parquet(f"{tmp_path}/out")).collect()}
    assert spark.read.parquet(f"{tmp_path}/out").select("batch").distinct().count() == 2
    assert len(got["Rosa Diaz"]["sources_ingested"]) == 3  # both batches are in the last version


def test_csv_folder_with_unequal_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,email\nAnn Lee,ann@x.org\n")
    (tmp_path / "b.csv").write_text("\ufeffEmail,Bio,Name\nbob@x.org,\"two\nlines\",Bob Ray\n")
    got = DelimitedSource(str(tmp_path)).extract(spark, 0, AT).select("full_name", "emails", "headline").collect()
    assert sorted((r["full_name"], r["emails"], r["headline"]) for r in got) == [("Ann Lee", ["ann@x.org"], None), ("Bob Ray", ["bob@x.org"], "two\nlines")]


def test_odd_items_of_json_lists(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"name": "Ann Lee", "jobs": [{"company": "X", "current": "false"}, "junk", None, {"company": "Y", "title": "0", "current": False}], "education": [3, {"school": "S"}]}]))
    row = DocumentSource(str(tmp_path / "a.json")).extract(spark, 0, AT).head()
    assert [(j["company"], j["title"], j["is_current"]) for j in row["experience"]] == [("X", None, True), ("Y", "0", False)]
    assert [e["institution"] for e in row["education"]] == ["S"]
    for k, text in enumerate(("[1] x", "{'a': 1}", "[{\"name\": \"A\"}", "7", "", "[]", "1, 2")):
        (tmp_path / f"bad{k}.json").write_text(text)
        assert DocumentSource(str(tmp_path / f"bad{k}.json")).extract(spark, 0, AT).count() == 0


def test_large_json_documents_keep_all_records(spark, tmp_path):
    record = json.dumps({"name": "Ann Lee", "email": "ann@x.org", "bio": "x" * 930})
    count = (141 << 20) // len(record)
    (tmp_path / "large.json").write_text("[" + ",".join([record] * count) + "]")
    assert DocumentSource(str(tmp_path / "large.json")).extract(spark, 0, AT).count() == count


def test_a_candidate_with_very_many_records(spark):
    from fusionweft.schemas import raw_columns

    number = F.col("id")
    job = F.array(F.struct(F.concat(F.lit("C"), (number % 50).cast("string")).alias("company"), F.lit("dev").alias("title"), F.lit(None).cast("string").alias("start"), F.lit(None).cast("string").alias("end"), F.lit(True).alias("is_current"), F.lit(None).cast("string").alias("summary")))
    links = F.array(F.struct(F.lit("portfolio").alias("type"), F.concat(F.lit("https://p.example/"), (number % 9).cast("string")).alias("url")))
    phones = F.array(F.concat(F.lit("+1415555"), F.lpad((number % 3000).cast("string"), 4, "0")))
    raw = spark.range(20_000).select(*raw_columns(source_id=F.concat(F.lit("csv:"), (number % 4).cast("string")), source_type=F.lit("csv"), extracted_at=F.lit("2024-01-02T03:04:05").cast("timestamp_ntz"), full_name=F.lit("Ann Lee"), emails=F.array(F.lit("shared@x.org")), phones=phones, skills_raw=F.array(F.concat(F.lit("tool "), (number % 40).cast("string"))), experience=job, links=links, src_idx=F.lit(0), row_idx=number))
    got = candidates(raw).collect()
    assert len(got) == 1 and got[0]["emails"] == ["shared@x.org"] and len(got[0]["skills"]) == 40 and len(got[0]["experience"]) == 50
    assert len(got[0]["phones"]) == len(set(got[0]["phones"])) and len(got[0]["sources_ingested"]) == 20_000
    assert got[0]["links"]["portfolio"] == "https://p.example/0" and len(got[0]["links"]["other"]) == 9


def test_profiles_fetched_by_links(spark):
    class Answer:
        status_code, headers = 200, {}

        def __init__(self, body):
            self.json = lambda: body

    asked = []

    def get(url, timeout):
        asked.append(url)
        return Answer([{"language": "Go", "size": 3, "fork": False}] if "repos" in url else {"name": "A B", "email": "a@x.org"})

    source = fetched(spark, ["https://github.com/a-b/", "a-b", "https://github.com/orgs/x", "not a login"], Fetcher(get))
    row = source.extract(spark, 0, AT).collect()
    assert [(r["full_name"], r["skills_raw"]) for r in row] == [("A B", ["Go"])] and len(asked) == 2
