"""Merging: all records of one candidate become one row, with provenance for every value that was considered.

Records are normalised where they are read and reduced to what merging needs. One exchange then brings a candidate's
records together; everything after it is higher-order functions over the ordered array, without further shuffles. What has to be
grouped in there is sorted, so a candidate with very many records (a shared address) costs n log n. Order is
semantic: ascending source priority, then source, row and position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, people, places, skills, urls
from ..functions.core import let, py_round3, strip
from ..schemas import DEFAULT_PRIORITY, EDUCATION, EXPERIENCE, LINKS, PRIORITY, VERSION
from .identity import candidate_id

_KEYED = EXPERIENCE.replace("source:string", "source:string,key:string")


def priority(source_type: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in PRIORITY.items() for x in p]), source_type), F.lit(DEFAULT_PRIORITY))


def _values(raw: Column, normalise) -> Column:
    """array<struct<raw, value, conf>> of the entries that normalise."""
    pairs = F.transform(raw, lambda r: let(normalise(r), lambda n: F.struct(r.alias("raw"), n["value"].alias("value"), n["conf"].alias("conf"))))
    return F.filter(pairs, lambda p: p["value"].isNotNull() & (p["value"] != ""))


def _experience(items: Column, source: Column) -> Column:
    squeezed = lambda c: F.regexp_replace(F.lower(c), r"(?U)\s+", "")

    def entry(e: Column) -> Column:
        company, title = strip(F.coalesce(e["company"], F.lit(""))), strip(F.coalesce(e["title"], F.lit("")))
        start = F.when(e["start"] != "", dates.start(e["start"]))
        end = F.when(e["end"] != "", dates.date(e["end"]))
        built = lambda s, d: F.struct(company.alias("company"), title.alias("title"), s.alias("start"), F.when(~d["current"], d["value"]).alias("end"), (F.coalesce(e["is_current"], F.lit(False)) | F.coalesce(d["current"], F.lit(False))).alias("is_current"), e["summary"].alias("summary"), source.alias("source"), F.concat_ws("|", squeezed(company), squeezed(title), F.coalesce(s, F.lit(""))).alias("key"))
        return let(start, lambda s: let(end, lambda d: built(s, d)))

    return F.filter(F.transform(items, entry), lambda e: (e["company"] != "") | (e["title"] != "")).cast(_KEYED)


def _education(items: Column, source: Column) -> Column:
    def entry(e: Column) -> Column:
        institution = strip(F.coalesce(e["institution"], F.lit("")))
        year = strip(e["end_year"])
        number = F.when(year.rlike(r"^[+-]?\d{1,9}$"), year.cast("int"))
        return F.struct(institution.alias("institution"), e["degree"].alias("degree"), e["field"].alias("field_of_study"), number.alias("end_year"), source.alias("source"))

    return F.filter(F.transform(items, entry), lambda e: e["institution"] != "").cast(EDUCATION)


def normalised(raw: DataFrame) -> DataFrame:
    """The narrow rows that are shuffled: candidate_id, the sort key and the normalised values of each record."""
    source, p = F.col("source_id"), F.col("prio")
    base = raw.withColumns(
        {
            "prio": priority(F.col("source_type")),
            "emails": _values(F.col("emails"), people.email),
            "phones": _values(F.col("phones"), people.phone),
            "name": people.name(F.col("full_name")),
            "loc": places.location(F.col("location_raw")),
            "skills": _values(F.col("skills_raw"), skills.skill),
        }
    )
    fixed = F.col("source_type").isin("csv", "ats_json")
    method = F.when(fixed, "structured_field").otherwise("regex")
    less = F.when(F.col("source_type") == "github", 0.85).otherwise(1.0)
    headline = F.substring(strip(F.col("headline")), 1, 200)

    def fact(field: str, how, raw_value: Column, value: Column, conf: Column, loc: Column | None = None) -> Column:
        how = how if isinstance(how, Column) else F.lit(how)
        where = F.lit(None).cast("struct<city:string,region:string,country:string,raw:string>") if loc is None else loc
        return F.struct(F.lit(field).alias("field"), source.alias("source"), how.alias("method"), raw_value.alias("raw_value"), value.alias("normalized_value"), conf.alias("conf"), F.col("extracted_at").alias("extracted_at"), where.alias("loc"))

    loc = F.col("loc")
    place = F.struct(*[loc[x].alias(x) for x in ("city", "region", "country", "raw")])
    scalars = F.array(
        F.when(F.col("name.value").isNotNull(), fact("full_name", "structured_field", F.col("full_name"), F.col("name.value"), F.col("name.conf") * p)),
        F.when((F.col("location_raw") != "") & ~places.is_empty(loc), fact("location", "structured_field", F.col("location_raw"), places.as_text(loc), loc["conf"] * p, place)),
        F.when(F.col("headline") != "", fact("headline", "structured_field", headline, headline, F.lit(0.7) * p)),
    )
    facts = F.concat(
        F.transform("emails", lambda e: fact("emails", method, e["raw"], e["value"], e["conf"] * p)),
        F.transform("phones", lambda e: fact("phones", method, e["raw"], e["value"], e["conf"] * p)),
        F.filter(scalars, lambda s: s.isNotNull()),
    )
    links = F.transform(F.filter("links", lambda x: x["url"] != ""), lambda x: let(urls.url(x["url"])["value"], lambda u: F.struct(x["type"].alias("type"), urls.classify(u).alias("kind"), u.alias("url"))))
    who = candidate_id(F.transform("emails", lambda e: e["value"]), F.col("name.value"), F.transform("phones", lambda e: e["value"]), source, F.col("extracted_at"))
    return base.select(
        who.alias("candidate_id"),
        "prio",
        "src_idx",
        "row_idx",
        "source_id",
        "extracted_at",
        facts.alias("facts"),
        F.transform("skills", lambda s: F.struct(s["value"].alias("name"), s["raw"].alias("raw"), (s["conf"] * p * less).alias("conf"), source.alias("source"))).alias("skills"),
        _experience(F.col("experience"), source).alias("experience"),
        _education(F.col("education"), source).alias("education"),
        F.filter(links, lambda x: x["url"].isNotNull()).alias("links"),
    )


#: Fixed value: up to so many entries, looking for equal ones one by one is quicker than sorting; it bounds the square.
FEW = 64


def _heads(keys: Column, entries: Column) -> Column:
    """The entries whose key is not that of an earlier one."""
    return F.filter(entries, lambda _, i: F.array_position(keys, F.get(keys, i)) == i + 1)


def _groups(items: Column, key) -> Column:
    """The entries (with their places: struct<k, i, x>) of equal keys (key(entry, place), never null), in order, as an array for each
    key. Many are sorted, so that the work grows with n log n however many records a candidate has."""
    new = lambda s: F.filter(F.transform(s, lambda x, j: F.when((j == 0) | ~F.get(s, j - 1)["k"].eqNullSafe(x["k"]), j)), lambda j: j.isNotNull())
    cut = lambda s, at: F.transform(at, lambda j, g: F.slice(s, j + 1, F.coalesce(F.get(at, g + 1), F.size(s)) - j))
    keyed = lambda all_: F.sort_array(F.transform(all_, lambda x, i: F.struct(key(x, i).alias("k"), i.alias("i"))))
    full = lambda all_, s: F.transform(s, lambda e: F.struct(e["k"].alias("k"), e["i"].alias("i"), F.get(all_, e["i"]).alias("x")))
    many = lambda all_: let(keyed(all_), lambda s: let(full(all_, s), lambda f: let(new(f), lambda at: cut(f, at))))
    entries = lambda all_: F.transform(all_, lambda x, i: F.struct(key(x, i).alias("k"), i.alias("i"), x.alias("x")))
    same = lambda e: F.transform(_heads(e["k"], e), lambda h: F.filter(e, lambda x: x["k"] == h["k"]))
    return let(items, lambda all_: F.when(F.size(all_) <= FEW, let(entries(all_), same)).otherwise(many(all_)))


def _first_of(items: Column, key) -> Column:
    """The entries whose key has not occurred before."""
    first = lambda g: F.get(g, F.lit(0))
    placed = lambda all_: F.sort_array(F.transform(_groups(all_, key), lambda g: F.struct(first(g)["i"].alias("i"), first(g)["x"].alias("x"))))
    few = lambda all_: let(F.transform(all_, key), lambda keys: _heads(keys, all_))
    return let(items, lambda all_: F.when(F.size(all_) <= FEW, few(all_)).otherwise(F.transform(placed(all_), lambda e: e["x"])))


def _winner(facts: Column, field: str) -> Column:
    """The fact of a field with the highest unrounded confidence, the earliest of equals."""
    own = F.filter(facts, lambda f: f["field"] == field)
    return let(own, lambda o: let(F.array_max(F.transform(o, lambda f: f["conf"])), lambda top: F.get(F.filter(o, lambda f: f["conf"] == top), F.lit(0))))


def _skills(items: Column) -> Column:
    def fused(group: Column) -> Column:
        first = F.get(group, F.lit(0))
        every = lambda name: F.array_distinct(F.transform(group, lambda e: e["x"][name]))
        return let(
            py_round3(F.array_max(F.transform(group, lambda e: e["x"]["conf"]))),
            lambda c: F.struct((-c).alias("o"), first["i"].alias("i"), F.struct(first["k"].alias("name"), every("raw").alias("aliases_seen"), c.alias("confidence"), every("source").alias("sources")).alias("s")),
        )

    return F.transform(F.sort_array(F.transform(_groups(items, lambda s, _: s["name"]), fused)), lambda x: x["s"])


def _merged_experience(items: Column) -> Column:
    """Equal company, title and start are one entry that names all its sources; latest start first."""

    def folded(group: Column) -> Column:
        first = F.get(group, F.lit(0))
        sources = F.array_distinct(F.transform(group, lambda e: e["x"]["source"]))
        named = F.aggregate(F.slice(sources, F.lit(2), F.size(sources)), F.get(sources, F.lit(0)), lambda all_, s: F.when(all_.contains(s), all_).otherwise(F.concat(all_, F.lit(","), s)))
        return F.struct(F.coalesce(first["x"]["start"], F.lit("0000")).alias("o"), (-first["i"]).alias("i"), first["x"].withField("source", named).dropFields("key").alias("e"))

    keyed = F.transform(_groups(items, lambda e, _: e["key"]), folded)
    return F.transform(F.sort_array(keyed, asc=False), lambda x: x["e"]).cast(EXPERIENCE)


def _merged_education(items: Column) -> Column:
    once = _first_of(items, lambda e, _: F.struct(F.lower(e["institution"]), e["end_year"]))
    keyed = F.transform(once, lambda e, i: F.struct(F.coalesce(e["end_year"], F.lit(0)).alias("o"), (-i).alias("i"), e.alias("e")))
    return F.transform(F.sort_array(keyed, asc=False), lambda x: x["e"]).cast(EDUCATION)


def _merged_links(items: Column) -> Column:
    """Lowest priority first: the first link of a kind takes its place, every later one goes to `other`, each once."""
    return let(items, _placed_links)


def _placed_links(items: Column) -> Column:
    first = lambda holds: F.get(F.filter(F.transform(items, lambda x, i: F.when(holds(x, i), i)), lambda i: i.isNotNull()), F.lit(0))
    no = F.lit(-1)

    def told(li: Column, gh: Column, pf: Column) -> Column:
        url = lambda i: F.get(items, F.when(i >= 0, i))["url"]
        rest = F.filter(F.transform(items, lambda x, i: F.when((i != li) & (i != gh) & (i != pf), x["url"])), lambda u: u.isNotNull())
        return F.struct(url(li).alias("linkedin"), url(gh).alias("github"), url(pf).alias("portfolio"), F.array_distinct(rest).alias("other")).cast(LINKS)

    of_kind = lambda kind: F.coalesce(first(lambda x, i: x["kind"] == kind), no)
    portfolio = lambda li, gh: F.coalesce(first(lambda x, i: (x["type"] == "portfolio") & (i != li) & (i != gh)), no)
    return let(of_kind("linkedin"), lambda li: let(of_kind("github"), lambda gh: let(portfolio(li, gh), lambda pf: told(li, gh, pf))))


def spread(raw: DataFrame, *key: str) -> DataFrame:
    """The records dealt evenly over tasks by a key that few share. Normalising takes long for its bytes, and tables that compress well
    (or files that cannot be split) come as a few tasks. The number is given, as Spark would join small partitions again: that of
    shuffle partitions, or less where so many tasks would only take time to start."""
    spark = raw.sparkSession
    return raw.repartition(min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(64, 4 * spark.sparkContext.defaultParallelism)), *key)


def merge(raw: DataFrame) -> DataFrame:
    """One row for each candidate, without its score. `_first` is the place of its first record, which output is ordered by."""
    return merge_normalised(normalised(raw))


def merge_normalised(rows: DataFrame) -> DataFrame:
    """merge() of rows that normalised() has made."""
    # lists that are pruned by themselves: what a query does not ask for is neither normalised nor shuffled
    listed = lambda *parts: F.sort_array(F.collect_list(F.struct("prio", "src_idx", "row_idx", "source_id", "extracted_at", *parts)))
    groups = rows.groupBy("candidate_id").agg(
        listed("facts").alias("f"),
        listed("skills").alias("s"),
        listed("experience", "education", "links").alias("r"),
        F.min(F.struct("src_idx", "row_idx")).alias("_first"),
        F.max("extracted_at").alias("created_at"),
    )
    flat = lambda name, part: F.flatten(F.transform(name, lambda x: x[part]))
    ordered = F.sort_array(F.transform("f", lambda x: F.struct(x["src_idx"], x["row_idx"], x["source_id"].alias("source_id"))))
    parts = groups.select(
        "candidate_id",
        "created_at",
        "_first",
        F.transform(ordered, lambda x: x["source_id"]).alias("sources_ingested"),
        flat("f", "facts").alias("f"),
        flat("s", "skills").alias("s"),
        flat("r", "experience").alias("x"),
        flat("r", "education").alias("e"),
        flat("r", "links").alias("l"),
    )
    # a value counts once among e-mails and phones; of other fields every fact does
    parts = parts.withColumn("f", _first_of(F.col("f"), lambda f, i: F.when(f["field"].isin("emails", "phones"), F.concat(f["field"], F.lit(":"), f["normalized_value"])).otherwise(i.cast("string"))))
    for field in ("full_name", "location", "headline"):
        parts = parts.withColumn(f"w_{field}", _winner(F.col("f"), field))

    def shown(f: Column) -> Column:
        won = F.when(f["field"] == "full_name", F.col("w_full_name.source")).when(f["field"] == "location", F.col("w_location.source")).when(f["field"] == "headline", F.col("w_headline.source"))
        beaten = let(won, lambda w: F.when(f["source"] != w, F.concat(F.lit("source_priority:"), w, F.lit("_wins"))))
        entry = lambda b: F.struct(*[f[n].alias(n) for n in ("field", "source", "method", "raw_value", "normalized_value")], py_round3(F.least(f["conf"], F.lit(1.0))).alias("confidence"), f["extracted_at"].alias("extracted_at"), b.isNotNull().alias("conflict"), b.alias("conflict_resolution"))
        return let(beaten, entry)

    values = lambda field: F.sort_array(F.transform(F.filter("f", lambda f: f["field"] == field), lambda f: f["normalized_value"]))
    return parts.select(
        "candidate_id",
        F.col("w_full_name.normalized_value").alias("full_name"),
        values("emails").alias("emails"),
        values("phones").alias("phones"),
        F.col("w_location.loc").alias("location"),
        F.col("w_headline.normalized_value").alias("headline"),
        F.lit(None).cast("double").alias("years_experience"),
        _skills(F.col("s")).alias("skills"),
        _merged_experience(F.col("x")).alias("experience"),
        _merged_education(F.col("e")).alias("education"),
        _merged_links(F.col("l")).alias("links"),
        F.transform("f", shown).alias("provenance"),
        "sources_ingested",
        "created_at",
        F.lit(VERSION).alias("pipeline_version"),
        "_first",
    )
