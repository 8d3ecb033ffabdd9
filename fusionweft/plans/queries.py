"""Queries for every operator over the test tables, and the SQL that each equals.

The tables hold no profiles, so inputs are derived from keys by SQL that both engines understand; texts and urls are real ones.
Operators run on whole tables.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, people, places, skills, urls
from ..functions.core import py_round3, py_title
from ..operators import facts as fact_rows
from ..operators.identity import hash_id, uuid5_id, with_identity
from ..operators.merge import merge, spread
from ..operators.projection import project
from ..operators.score import WEIGHTS, with_score
from ..operators.validate import schema_errors, semantic_warnings
from ..schemas import raw_columns
from ..sources import documents as docs_source
from ..session import landing
from ..sources.delimited import DelimitedSource, keep, split_skills
from ..sources.documents import DocumentSource
from ..sources.rest import ProfileSource, languages
from .config import parse_config

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")
#: The year that validation takes for the present.
YEAR = 2024


def rows(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """SQL over the tables of a directory; {name} stands for a table."""
    for t in TABLES:
        sql = sql.replace("{" + t + "}", f"parquet.`{sf_dir}/{t}.parquet`")
    return spark.sql(sql)


def plain(sql: str) -> str:
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql


def query(name: str, source: str, select, oracle: str | None = None) -> None:
    """Registers select(frame of source) as a query; the oracle sees the source as `i`."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return select(rows(spark, sf_dir, source))

    QUERIES[name] = run
    if oracle:
        ORACLES[name] = f"WITH i AS ({plain(source)}) {oracle}" if not oracle.lstrip().upper().startswith("WITH") else f"WITH i AS ({plain(source)}), " + oracle.lstrip()[4:]


# ---- fragments of DuckDB SQL

def t_(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def cap_(w: str) -> str:
    return f"(upper(substr({w}, 1, 1)) || lower(substr({w}, 2)))"


def title_(s: str) -> str:
    return rf"array_to_string(list_transform(regexp_extract_all({s}, '(\p{{L}}+|[^\p{{L}}]+)'), lambda t: {cap_('t')}), '')"


def list_(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def map_(key: str, pairs: dict[str, str]) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k.replace(chr(39), chr(39) * 2)}' THEN '{v}'" for k, v in pairs.items()) + " END"


def round_(x: str) -> str:
    s = "1152921504606846976"
    n = f"(CAST(({x}) * {s}.0::DOUBLE AS HUGEINT) * 1000)"
    return f"(({n} // {s}) + CASE WHEN 2 * ({n} % {s}) > {s} OR (2 * ({n} % {s}) = {s} AND ({n} // {s}) % 2 = 1) THEN 1 ELSE 0 END)::DOUBLE / 1000.0::DOUBLE"


# ---- normalisers

_NAMES = """SELECT c_custkey AS k, CASE c_custkey % 10 WHEN 0 THEN c_mktsegment || ', anna   ' || c_name WHEN 1 THEN '  ' || lower(c_mktsegment) || ' van DER berg'
 WHEN 2 THEN 'o''brien-' || c_mktsegment WHEN 3 THEN 'van ' || c_name || ' (x)' WHEN 4 THEN '  ' WHEN 5 THEN NULL WHEN 6 THEN '(' || c_name || ')'
 WHEN 7 THEN c_mktsegment || ',' WHEN 8 THEN 'de-la ' || lower(c_name) || ' III' ELSE 'D''' || c_mktsegment || ' von ' || c_name END AS raw FROM {customer}"""


def name_sql(x: str) -> str:
    """CTEs from i(k, raw) to names(k, value, conf)."""
    p = list_(people.PARTICLES)
    return rf"""
 n1 AS (SELECT k, regexp_replace({t_(rf"regexp_replace({t_(x)}, '\(.*?\)', '', 'g')")}, '\s{{2,}}', ' ', 'g') AS n FROM i),
 n2 AS (SELECT k, n, CASE WHEN strpos(n, ',') > 0 THEN {t_("substr(n, strpos(n, ',') + 1)")} ELSE '' END AS f, {t_("substr(n, 1, greatest(strpos(n, ',') - 1, 0))")} AS l FROM n1),
 n3 AS (SELECT k, n, CASE WHEN f <> '' THEN {t_("f || ' ' || l")} ELSE n END AS m, CASE WHEN f <> '' THEN 0.9 ELSE 1.0 END AS c FROM n2),
 names AS (SELECT k, CASE WHEN n <> '' THEN array_to_string(list_transform(regexp_split_to_array(m, '\s+'), lambda w, j:
   CASE WHEN contains(w, '-') THEN array_to_string(list_transform(string_split(w, '-'), lambda q: CASE WHEN lower(q) IN ({p}) THEN lower(q) ELSE {cap_('q')} END), '-')
        WHEN contains(w, '''') THEN array_to_string(list_transform(string_split(w, ''''), lambda q: {cap_('q')}), '''')
        WHEN lower(w) IN ({p}) AND j > 1 THEN lower(w) ELSE {cap_('w')} END), ' ') END AS value,
   CASE WHEN n <> '' THEN c ELSE 0 END::DOUBLE AS conf FROM n3)"""


query("name_norm", _NAMES, lambda d: d.select("k", people.name(F.col("raw")).alias("v")).select("k", "v.value", "v.conf"), f"WITH {name_sql('raw')} SELECT * FROM names")

_EMAILS = """SELECT c_custkey AS k, CASE c_custkey % 12 WHEN 0 THEN 'MAILTO:User' || c_custkey || '@Example.com' WHEN 1 THEN '<' || c_name || '@x.org>' WHEN 2 THEN ' a..b' || c_custkey || '@x.org '
 WHEN 3 THEN 'no-at-' || c_custkey WHEN 4 THEN '@x.org' WHEN 5 THEN 'u' || c_custkey || '@nodot' WHEN 6 THEN 'u+' || c_custkey || '@GMAIL.com' WHEN 7 THEN 'a@b' || c_custkey || '@c.de'
 WHEN 8 THEN NULL WHEN 9 THEN '  ' WHEN 10 THEN 'mailto:<x.' || c_custkey || '+tag+two@googlemail.com>' ELSE 'u' || c_custkey || '+t@mail.com' END AS raw FROM {customer}"""


def email_sql(x: str) -> str:
    e = t_(rf"regexp_replace(regexp_replace({t_(x)}, '^mailto:', '', 'i'), '^<(.+)>$', '\1')")
    return e


_EMAIL_CTES = rf"""e1 AS (SELECT k, {email_sql('raw')} AS e FROM i),
 e2 AS (SELECT k, CASE WHEN strpos(e, '@') > 1 AND contains(substr(e, strpos(e, '@') + 1), '.') AND NOT contains(substr(e, 1, strpos(e, '@') - 1), '..') THEN lower(e) END AS value FROM e1)"""
query("email_norm", _EMAILS, lambda d: d.select("k", people.email(F.col("raw")).alias("v")).select("k", "v.value", "v.conf"), f"WITH {_EMAIL_CTES} SELECT k, value, CASE WHEN value IS NULL THEN 0 ELSE 1 END::DOUBLE AS conf FROM e2")
query(
    "gmail_fold",
    _EMAILS,
    lambda d: d.select("k", people.email(F.col("raw"))["value"].alias("v")).select("k", people.is_alias(F.col("v")).alias("alias"), people.base_address(F.col("v")).alias("base")),
    rf"WITH {_EMAIL_CTES} SELECT k, coalesce(regexp_matches(value, '^[^@]*\+[^@]*@(gmail|googlemail)\.com$'), false) AS alias, regexp_replace(value, '^([^+@]*)\+[^@]*@', '\1@') AS base FROM e2",
)
_TEXTS = "SELECT doc_id AS k, text AS raw FROM {documents} UNION ALL SELECT 1000000000 + conv_id * 1000 + turn AS k, text AS raw FROM {conversations}"
_AT = people.EMAIL_IN_TEXT.replace("'", "''")
query(
    "email_extract",
    _TEXTS,
    lambda d: d.select("k", F.array_join(people.emails_in(F.col("raw")), " ").alias("found")),
    rf"""WITH f AS (SELECT k, unnest(regexp_extract_all(raw, '{_AT}')) AS e, generate_subscripts(regexp_extract_all(raw, '{_AT}'), 1) AS p FROM i),
 g AS (SELECT k, lower(e) AS e, min(p) AS p FROM f WHERE NOT contains(split_part(e, '@', 1), '..') GROUP BY 1, 2)
 SELECT i.k, coalesce(string_agg(g.e, ' ' ORDER BY g.p), CASE WHEN any_value(i.raw) IS NULL THEN NULL ELSE '' END) AS found FROM i LEFT JOIN g ON g.k = i.k GROUP BY i.k""",
)
_PHONES = """SELECT c_custkey AS k, CASE c_custkey % 10 WHEN 0 THEN '(415) 555-' || lpad(cast(c_custkey AS string), 4, '0') WHEN 1 THEN '+44 20 ' || lpad(cast(c_custkey AS string), 8, '1')
 WHEN 2 THEN '0049 30 ' || lpad(cast(c_custkey AS string), 7, '2') WHEN 3 THEN '1-650-555-' || lpad(cast(c_custkey AS string), 4, '0') || ' ext. 12' WHEN 4 THEN '555-12' WHEN 5 THEN NULL
 WHEN 6 THEN '650.555.' || lpad(cast(c_custkey AS string), 4, '0') || 'x99' WHEN 7 THEN '2-650-555-0000' WHEN 8 THEN '+123456789012345' || cast(c_custkey AS string) ELSE '123 4567' END AS raw FROM {customer}"""
_PHONE_CTES = rf"""p1 AS (SELECT k, {t_(rf"regexp_replace({t_('raw')}, '\s*(ext\.?|x)\s*\d+$', '', 'i')")} AS p FROM i),
 p2 AS (SELECT k, p, regexp_replace(p, '\D', '', 'g') AS d FROM p1),
 p3 AS (SELECT k, CASE WHEN length(d) NOT BETWEEN 7 AND 15 THEN NULL WHEN starts_with(p, '+') THEN '+' || d WHEN starts_with(p, '00') THEN '+' || substr(d, 3)
   WHEN length(d) = 10 THEN '+1' || d WHEN length(d) = 11 AND starts_with(d, '1') THEN '+' || d END AS value, CASE WHEN starts_with(p, '+') OR starts_with(p, '00') THEN 0.6 ELSE 0.5 END AS c FROM p2)"""
query("phone_norm", _PHONES, lambda d: d.select("k", people.phone(F.col("raw")).alias("v")).select("k", "v.value", "v.conf"), f"WITH {_PHONE_CTES} SELECT k, value, CASE WHEN value IS NULL THEN 0 ELSE c END::DOUBLE AS conf FROM p3")

_ONE_DATE = """CASE o_orderkey % 12 WHEN 0 THEN cast(year(o_orderdate) AS string) || '-' || cast(month(o_orderdate) AS string) WHEN 1 THEN cast(month(o_orderdate) AS string) || '/' || cast(year(o_orderdate) AS string)
 WHEN 2 THEN m || '. ' || cast(year(o_orderdate) AS string) WHEN 3 THEN cast(year(o_orderdate) AS string) || ' ' || lower(m) WHEN 4 THEN m || ' ''' || lpad(cast(year(o_orderdate) % 100 AS string), 2, '0') WHEN 5 THEN cast(year(o_orderdate) AS string)
 WHEN 6 THEN ' Present ' WHEN 7 THEN '2020-13' WHEN 8 THEN 'Sept 2020' WHEN 9 THEN NULL WHEN 10 THEN '1900' ELSE cast(year(o_orderdate) AS string) || '-01-02' END"""
_MONTHS = "SELECT *, CASE month(o_orderdate) WHEN 1 THEN 'Jan' WHEN 2 THEN 'February' WHEN 3 THEN 'Mar' WHEN 4 THEN 'APR' WHEN 5 THEN 'May' WHEN 6 THEN 'June' WHEN 7 THEN 'Jul' WHEN 8 THEN 'Aug' WHEN 9 THEN 'September' WHEN 10 THEN 'Oct' WHEN 11 THEN 'Nov' ELSE 'December' END AS m FROM {orders}"
_DATES = f"SELECT o_orderkey AS k, {_ONE_DATE} AS raw FROM ({_MONTHS}) o"


def date_sql(x: str) -> tuple[str, str, str]:
    """Expressions for value, current and confidence of a text."""
    t = f"lower({t_(x)})"
    month = lambda e: f"CASE WHEN lpad({e}, 2, '0') BETWEEN '01' AND '12' THEN lpad({e}, 2, '0') END"
    g = lambda p, k: f"regexp_extract({t}, '{p}', {k})"
    a, b, c, d, e = r"^(\d{4})[-/](\d{1,2})$", r"^(\d{1,2})[-/](\d{4})$", r"^([a-z]+)\.?\s+(\d{4})$", r"^(\d{4})\s+([a-z]+)$", r"^([a-z]+)\.?\s+[''`](\d{2})$"
    rows_ = [
        (a, f"{g(a, 1)} || '-' || {month(g(a, 2))}", 1.0),
        (b, f"{g(b, 2)} || '-' || {month(g(b, 1))}", 1.0),
        (c, f"{g(c, 2)} || '-' || {map_(g(c, 1), dates.MONTHS)}", 1.0),
        (d, f"{g(d, 1)} || '-' || {map_(g(d, 2), dates.MONTHS)}", 0.95),
        (e, f"CASE WHEN {g(e, 2)} <= '30' THEN '20' ELSE '19' END || {g(e, 2)} || '-' || {map_(g(e, 1), dates.MONTHS)}", 0.85),
        (r"^\d{4}$", f"CASE WHEN {t} BETWEEN '1950' AND '2050' THEN {t} END", 0.8),
    ]
    now = f"{t} IN ({list_(dates.CURRENT)})"
    value = f"CASE WHEN {now} THEN NULL " + " ".join(f"WHEN regexp_matches({t}, '{p}') THEN {v}" for p, v, _ in rows_) + " END"
    conf = f"CASE WHEN {now} THEN 1.0 " + " ".join(f"WHEN regexp_matches({t}, '{p}') THEN CASE WHEN ({v}) IS NULL THEN 0.0 ELSE {n} END" for p, v, n in rows_) + " ELSE 0.0 END::DOUBLE"
    return value, f"coalesce({now}, false)", conf


_V, _N, _C = date_sql("raw")
query("date_norm", _DATES, lambda d: d.select("k", dates.date(F.col("raw")).alias("v")).select("k", "v.value", "v.current", "v.conf"), f"SELECT k, {_V} AS value, {_N} AS current, {_C} AS conf FROM i")
_RANGES = f"""SELECT o_orderkey AS k, CASE o_orderkey % 7 WHEN 0 THEN raw || ' - Present' WHEN 1 THEN raw || ' – 2021-06' WHEN 2 THEN 'Jan 2001 to ' || raw WHEN 3 THEN raw || '—' || raw WHEN 4 THEN raw || ' to now' WHEN 5 THEN raw ELSE raw || ' — nonsense' END AS raw
 FROM (SELECT o_orderkey, {_ONE_DATE} AS raw FROM ({_MONTHS}) o) d"""
_A, _AN, _AC = date_sql("a")
_B, _BN, _BC = date_sql("b")
_SEP = "CASE " + " ".join(f"WHEN contains(raw, '{s}') THEN '{s}'" for s in dates.SEPARATORS) + " END"
query(
    "date_range",
    _RANGES,
    lambda d: d.select("k", dates.date_range(F.col("raw")).alias("v")).select("k", F.col("v.start").alias("start_"), F.col("v.end").alias("end_"), "v.current", "v.conf"),
    f"""WITH s AS (SELECT k, raw, {_SEP} AS sep FROM i), c AS (SELECT k, sep, CASE WHEN sep IS NULL THEN raw ELSE substr(raw, 1, strpos(raw, sep) - 1) END AS a, CASE WHEN sep IS NOT NULL THEN substr(raw, strpos(raw, sep) + length(sep)) END AS b FROM s)
 SELECT k, {_A} AS start_, CASE WHEN sep IS NULL THEN NULL ELSE {_B} END AS end_, CASE WHEN sep IS NULL THEN {_AN} ELSE {_BN} END AS current,
 CASE WHEN sep IS NULL OR {_BN} THEN {_AC} ELSE least({_AC}, {_BC}) END AS conf FROM c""",
)
_PLACES = """SELECT c_custkey AS k, CASE c_custkey % 14 WHEN 0 THEN n_name WHEN 1 THEN 'saint-john''s ' || lower(n_name) || ', CA' WHEN 2 THEN n_name || ', new york' WHEN 3 THEN lower(n_name) || ', UK' WHEN 4 THEN 'paris, ile de france' WHEN 5 THEN 'Austin, tx, USA'
 WHEN 6 THEN 'munich, bayern, germany' WHEN 7 THEN 'Remote - ' || n_name WHEN 8 THEN ' ' WHEN 9 THEN NULL WHEN 10 THEN ' uae ' WHEN 11 THEN 'x,' WHEN 12 THEN n_name || ', a, b, Taiwan' ELSE 'remotely ' || n_name END AS raw FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey"""
_ST = lambda x: f"coalesce({map_(f'lower({x})', places.STATES)}, CASE WHEN upper({x}) IN ({list_(places.STATES.values())}) THEN upper({x}) END)"
_CO = lambda x: map_(f"lower({x})", places.COUNTRIES)
query(
    "location_norm",
    _PLACES,
    lambda d: d.select("k", places.location(F.col("raw")).alias("v")).select("k", "v.city", "v.region", "v.country", "v.raw", "v.conf"),
    rf"""WITH r AS (SELECT k, coalesce({t_('raw')}, '') AS r FROM i), s AS (SELECT k, r, string_split(r, ',') AS p FROM r),
 q AS (SELECT k, r, len(p) AS n, {t_('p[1]')} AS a, {t_("coalesce(p[2], '')")} AS b, {t_('p[-1]')} AS z, r = '' AS nil, regexp_matches(r, '\bremote\b', 'i') AS far FROM s)
 SELECT k, r AS raw, CASE WHEN nil OR far OR (n = 1 AND {_CO('a')} IS NOT NULL) THEN NULL ELSE {title_('a')} END AS city,
 CASE WHEN nil OR far OR n = 1 THEN NULL WHEN {_ST('b')} IS NOT NULL THEN {_ST('b')} WHEN n = 2 AND {_CO('b')} IS NOT NULL THEN NULL ELSE {title_('b')} END AS region,
 CASE WHEN nil OR far THEN NULL WHEN n = 1 THEN {_CO('a')} WHEN n = 2 AND {_ST('b')} IS NOT NULL THEN 'US' WHEN n = 2 THEN {_CO('b')} ELSE {_CO('z')} END AS country,
 CASE WHEN nil THEN 0 WHEN far THEN 0.7 WHEN n = 1 AND {_CO('a')} IS NOT NULL THEN 0.8 WHEN n = 1 THEN 0.5 WHEN n = 2 AND {_ST('b')} IS NOT NULL THEN 0.95 WHEN n = 2 AND {_CO('b')} IS NOT NULL THEN 0.9 WHEN n = 2 THEN 0.75 ELSE 0.9 END::DOUBLE AS conf FROM q""",
)
_TAX = skills.taxonomy()
_ALIASES = "[" + ", ".join(f"{{'a': '{a}', 'c': '{c}'}}" for a, c in _TAX.items()) + "]"
_SKILLS = """SELECT p_partkey AS k, CASE p_partkey % 9 WHEN 0 THEN 'Python 3.' || p_partkey WHEN 1 THEN ' C++ ' WHEN 2 THEN lower(p_type) WHEN 3 THEN 'CI/CD' WHEN 4 THEN 'Spring Boot 3' WHEN 5 THEN NULL WHEN 6 THEN '!!' WHEN 7 THEN 'node.js' ELSE p_brand || '  (x)' END AS raw FROM {part}"""


def skill_sql(x: str, source: str) -> str:
    """A select of k, value, conf, known (and other columns of the source) for each text x."""
    c = rf"""{t_(rf"regexp_replace(regexp_replace({t_(x)}, '[^\w\s.+#-]', '', 'g'), '\s+', ' ', 'g')")}"""
    return rf"""SELECT * EXCLUDE (c, hit, exact), CASE WHEN coalesce(c, '') = '' THEN '' WHEN exact IS NOT NULL THEN exact WHEN hit IS NOT NULL THEN hit ELSE {title_('c')} END AS value,
 CASE WHEN coalesce(c, '') = '' THEN 0 WHEN exact IS NOT NULL THEN 1 WHEN hit IS NOT NULL THEN 0.9 ELSE 0.7 END::DOUBLE AS conf, coalesce(c, '') <> '' AND (exact IS NOT NULL OR hit IS NOT NULL) AS known
 FROM (SELECT *, list_filter({_ALIASES}, lambda z: z.a = lower(c))[1].c AS exact, list_filter({_ALIASES}, lambda z: starts_with(lower(c), z.a || ' ') OR starts_with(lower(c), z.a || '.'))[1].c AS hit FROM (SELECT *, {c} AS c FROM {source}))"""


query("skill_norm", _SKILLS, lambda d: d.select("k", skills.skill(F.col("raw")).alias("v")).select("k", "v.value", "v.conf", "v.known"), f"SELECT k, value, conf, known FROM ({skill_sql('raw', 'i')})")
_SKILL_LISTS = """SELECT p_partkey AS k, 'python;js|' || lower(p_brand) || ',Python 3.' || p_partkey || ', ReactJS ,react,,Go ' AS raw FROM {part}"""
query(
    "skill_list",
    _SKILL_LISTS,
    lambda d: d.select("k", skills.skill_list(split_skills(F.col("raw"))).alias("v")).select("k", F.array_join(F.transform("v", lambda s: F.concat_ws("=", s["value"], s["conf"].cast("decimal(3,1)").cast("string"))), ";").alias("found")),
    rf"""WITH l AS (SELECT k, unnest(regexp_split_to_array(raw, '[,;|]')) AS s, generate_subscripts(regexp_split_to_array(raw, '[,;|]'), 1) AS p FROM i), v AS ({skill_sql('s', 'l')}),
 g AS (SELECT k, value, max(conf) AS conf, min(p) AS p FROM v WHERE value <> '' GROUP BY 1, 2)
 SELECT k, string_agg(value || '=' || conf::DECIMAL(3,1)::VARCHAR, ';' ORDER BY p) AS found FROM g GROUP BY k""",
)
_BY_LENGTH = sorted(_TAX.items(), key=lambda x: -len(x[0]))
_VALUES = ", ".join(f"({k}, '{a}', '{c}', '(^|[^a-z0-9-]){''.join(chr(92) + x if not x.isalnum() and x != ' ' else x for x in a)}([^a-z0-9-]|$)')" for k, (a, c) in enumerate(_BY_LENGTH))
query(
    "skill_extract",
    _TEXTS,
    lambda d: d.select("k", F.array_join(skills.skills_in(F.col("raw")), ";").alias("found")),
    f"""WITH a(p, a, c, r) AS (VALUES {_VALUES}), f AS (SELECT k, c, min(p) AS p FROM i, a WHERE contains(lower(raw), a.a) AND regexp_matches(lower(raw), r) GROUP BY 1, 2)
 SELECT i.k, coalesce(string_agg(c, ';' ORDER BY p), CASE WHEN any_value(raw) IS NULL THEN NULL ELSE '' END) AS found FROM i LEFT JOIN f ON f.k = i.k GROUP BY i.k""",
)
_URLS = "SELECT page_id AS k, CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN upper(url) WHEN 2 THEN substr(url, instr(url, '://') + 3) || '//' WHEN 3 THEN url || '?' WHEN 4 THEN NULL ELSE ' ' || url || ' ' END AS raw FROM {pages}"
_URL_CTES = rf"""u1 AS (SELECT k, CASE WHEN regexp_matches({t_('raw')}, '^https?://', 'i') THEN regexp_replace({t_('raw')}, '^https?://', 'https://', 'i') ELSE 'https://' || {t_('raw')} END AS u FROM i),
 u2 AS (SELECT k, lower(regexp_extract(u, '^https://([^/?#]*)', 1)) AS h, regexp_replace(regexp_extract(u, '^https://[^/?#]*([^?#]*)', 1), '/+$', '') AS p, regexp_extract(u, '^[^?#]*(\?[^#]*)', 1) AS q, regexp_extract(u, '(#.*)$', 1) AS f FROM u1),
 u3 AS (SELECT k, CASE WHEN h <> '' THEN 'https://' || h || p || CASE WHEN length(q) > 1 THEN q ELSE '' END || CASE WHEN length(f) > 1 THEN f ELSE '' END END AS value FROM u2)"""
query("url_norm", _URLS, lambda d: d.select("k", urls.url(F.col("raw")).alias("v")).select("k", "v.value", "v.conf"), f"WITH {_URL_CTES} SELECT k, value, CASE WHEN value IS NULL THEN 0 ELSE 1 END::DOUBLE AS conf FROM u3")
_LINKS = "SELECT page_id AS k, CASE page_id % 6 WHEN 0 THEN 'https://www.LinkedIn.com/in/u' || page_id WHEN 1 THEN 'http://github.com/user-' || page_id || '/repo' WHEN 2 THEN 'https://github.com/orgs' WHEN 3 THEN url WHEN 4 THEN NULL ELSE 'https://www.github.com/U' || page_id END AS raw FROM {pages}"
query("url_classify", _LINKS, lambda d: d.select("k", urls.classify(F.col("raw")).alias("kind")), "SELECT k, CASE WHEN contains(lower(raw), 'linkedin.com') THEN 'linkedin' WHEN contains(lower(raw), 'github.com') THEN 'github' ELSE 'other' END AS kind FROM i")
query("gh_user", _LINKS, lambda d: d.select("k", urls.github_user(F.col("raw")).alias("login")), rf"WITH u AS (SELECT k, regexp_extract(raw, '^https?://(?:www\.)?github\.com/([a-zA-Z0-9\-]+)/?', 1) AS u FROM i) SELECT k, CASE WHEN u <> '' AND u NOT IN ({list_(urls.NO_USERS)}) THEN u END AS login FROM u")
query("py_title", "SELECT p_partkey AS k, p_name || ' o''neil-' || p_brand AS raw FROM {part}", lambda d: d.select("k", py_title(F.col("raw")).alias("v")), f"SELECT k, {title_('raw')} AS v FROM i")
query("py_round", "SELECT l_orderkey * 10 + l_linenumber AS k, 0.25 + l_discount * 7.125 + l_tax AS x FROM {lineitem}", lambda d: d.select("k", py_round3(F.col("x").cast("double")).alias("v")), f"SELECT k, {round_('x::DOUBLE')} AS v FROM i")

# ---- sources

query(
    "csv_guard",
    "SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS n, CASE c_custkey % 4 WHEN 0 THEN 'bad' WHEN 1 THEN NULL ELSE 'u' || c_custkey || '@x.org' END AS e, 'a, b;' || c_mktsegment || '||' AS s FROM {customer}",
    lambda d: d.where(keep(F.col("n"), F.col("e"))).select("k", F.array_join(split_skills(F.col("s")), "/").alias("skills")),
    rf"SELECT k, array_to_string(list_filter(list_transform(regexp_split_to_array(s, '[,;|]'), lambda x: {t_('x')}), lambda x: x <> ''), '/') AS skills FROM i WHERE n IS NOT NULL OR coalesce(contains(e, '@'), false)",
)
_RECORDS = """SELECT c_custkey AS k, '{' || CASE c_custkey % 3 WHEN 0 THEN '"email": null, ' WHEN 1 THEN '"email": "", ' ELSE '' END || '"emailAddress": "a' || c_custkey || '@x.org", "mobile": ' || c_custkey || ', "fullName": "' || c_name || '", "jobs": [{"employer": "' || c_mktsegment || '", "jobTitle": "", "title": null, "job_title": "dev", "startDate": "2020-01", "isCurrent": true}], "education": [{"university": "U' || c_custkey || '", "major": "m", "graduationYear": 2010}]}' AS record FROM {customer}"""


def _ats(d: DataFrame) -> DataFrame:
    e = d.select("k", F.map_entries(F.from_json("record", "map<string,string>")).alias("e"))
    got = e.select("k", *[docs_source.field(F.col("e"), n).alias(n) for n in ("full_name", "email", "phone", "experience", "education", "company", "title")])
    jobs, schools = docs_source.experience(F.col("experience"), F.col("company"), F.col("title")), docs_source.education(F.col("education"))
    got = got.withColumns({"j": F.get(jobs, F.lit(0)), "s": F.get(schools, F.lit(0))})
    return got.select("k", "full_name", "email", "phone", F.col("j.company").alias("company"), F.col("j.title").alias("title"), F.col("j.start").alias("start_"), F.col("j.is_current").alias("is_current"), F.col("s.institution").alias("institution"), F.col("s.field").alias("field"), F.col("s.end_year").alias("end_year"))


query(
    "ats_alias",
    _RECORDS,
    _ats,
    """SELECT k, record::JSON->>'$.fullName' AS full_name, CASE WHEN record::JSON->>'$.email' IS NOT NULL THEN record::JSON->>'$.email' ELSE record::JSON->>'$.emailAddress' END AS email, record::JSON->>'$.mobile' AS phone,
 record::JSON->>'$.jobs[0].employer' AS company, record::JSON->>'$.jobs[0].job_title' AS title, record::JSON->>'$.jobs[0].startDate' AS start_, true AS is_current,
 record::JSON->>'$.education[0].university' AS institution, record::JSON->>'$.education[0].major' AS field, record::JSON->>'$.education[0].graduationYear' AS end_year FROM i""",
)
_DOCS = """SELECT n_nationkey AS k, CASE n_nationkey % 5 WHEN 0 THEN '[{"a": 1}, 2, {"a": "' || n_name || '"}]' WHEN 1 THEN '{"candidates": [{"a": 3}]}' WHEN 2 THEN '{"data": {"a": 4}}' WHEN 3 THEN '{"a": "x"}' ELSE '{broken' END AS value FROM {nation}"""
query("json_roots", _DOCS, lambda d: docs_source.records(d).groupBy().agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.get_json_object("record", "$.a").try_cast("int"), F.lit(0))).cast("bigint").alias("total")), "SELECT sum(CASE k % 5 WHEN 0 THEN 2 WHEN 4 THEN 0 ELSE 1 END)::BIGINT AS n, sum(CASE k % 5 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 4 ELSE 0 END)::BIGINT AS total FROM i")
_REPOS = "SELECT cast(l_suppkey AS string) AS login, l_linenumber AS pos, CASE WHEN l_linestatus = 'O' THEN l_returnflag ELSE NULL END AS language, cast(l_quantity AS bigint) AS size, l_linenumber % 5 = 0 AS fork FROM {lineitem}"
query("lang_agg", _REPOS, lambda d: languages(d).select("login", "language", "size", F.col("pos").cast("bigint").alias("pos")), "SELECT login, language, sum(size)::BIGINT AS size, min(pos)::BIGINT AS pos FROM i WHERE NOT fork AND language IS NOT NULL GROUP BY 1, 2")

AT = datetime(2024, 1, 2, 3, 4, 5)


def _scanned(d: DataFrame, source) -> DataFrame:
    got = source.extract(d.sparkSession, 0, AT)
    text = lambda c: F.array_join(c, "/").alias
    job = F.get("experience", F.lit(0))
    return got.select("source_type", "full_name", text("emails")("emails"), "location_raw", "headline", text("skills_raw")("skills"), job["company"].alias("company"), job["title"].alias("title"), text(F.transform("links", lambda x: F.concat(x["type"], F.lit("="), x["url"])))("links"), F.concat_ws("|", F.transform("experience", lambda e: F.concat_ws(":", e["company"], e["is_current"].cast("string")))).alias("jobs"))


def _csv_scan(d: DataFrame) -> DataFrame:
    path = landing(d.sparkSession, "csv")
    names = {"n": "Candidate Name", "e": "E-Mail", "c": "City", "s": "skills", "b": "Bio", "o": "Employer", "t": "position", "l": "LinkedIn"}
    d.where("k % 2 = 0").select(*[F.col(a).alias(b) for a, b in names.items()]).write.csv(path, header=True, escape='"')
    d.where("k % 2 = 1").select(*[F.col(a).alias(names[a]) for a in reversed(names)]).write.mode("append").csv(path, header=True, escape='"')  # files with another order of columns
    return _scanned(d, DelimitedSource(path))


_PEOPLE = """SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_name END AS n, CASE c_custkey % 3 WHEN 0 THEN NULL ELSE 'u' || c_custkey || '@x.org' END AS e, 'San "X", ' || c_mktsegment AS c,
 'a; b,' || c_mktsegment AS s, CASE WHEN c_custkey % 5 = 0 THEN 'two' || chr(10) || 'lines' ELSE 'one' END AS b, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS o, 'dev' AS t, 'linkedin.com/in/u' || c_custkey AS l FROM {customer}"""
query(
    "csv_scan",
    _PEOPLE,
    _csv_scan,
    """SELECT 'csv' AS source_type, n AS full_name, coalesce(e, '') AS emails, c AS location_raw, b AS headline, 'a/b/' || split_part(c, ', ', 2) AS skills, o AS company, 'dev' AS title, 'linkedin=' || l AS links, CASE WHEN o IS NULL THEN 'true' ELSE o || ':true' END AS jobs
 FROM i WHERE n IS NOT NULL OR e IS NOT NULL""",
)


def _json_scan(d: DataFrame) -> DataFrame:
    path = landing(d.sparkSession, "json")
    d.select("record").write.text(path)
    return _scanned(d, DocumentSource(path, lines=True))


_LINES = """SELECT c_custkey AS k, c_name AS n, c_mktsegment AS m, '{"candidateName": "' || c_name || '", "email": "u' || c_custkey || '@x.org", "city": "' || c_mktsegment || '", "technologies": "a|' || c_mktsegment || '", "githubUrl": "https://github.com/u' || c_custkey || '", "jobs": [7, {"company": "' || c_mktsegment || '", "jobTitle": "dev", "current": '
 || CASE c_custkey % 6 WHEN 0 THEN 'false' WHEN 1 THEN '"false"' WHEN 2 THEN '0' WHEN 3 THEN '"0"' WHEN 4 THEN '""' ELSE 'null, "isCurrent": true' END || '}, "junk", null, {"employer": "second"}]}' AS record FROM {customer}"""
query(
    "json_scan",
    _LINES,
    _json_scan,
    """SELECT 'ats_json' AS source_type, n AS full_name, 'u' || k || '@x.org' AS emails, m AS location_raw, NULL::VARCHAR AS headline, 'a/' || m AS skills, m AS company, 'dev' AS title, 'github=https://github.com/u' || k AS links,
 m || ':' || CASE WHEN k % 6 IN (1, 3, 5) THEN 'true' ELSE 'false' END || '|second:false' AS jobs FROM i""",
)


def _rest_scan(d: DataFrame) -> DataFrame:
    profiles = d.select("login").distinct().select("login", F.when(F.col("login").cast("int") % 4 == 0, 404).otherwise(200).alias("status"), F.concat(F.lit("N"), "login").alias("name"), F.concat(F.lit("U"), "login", F.lit("@X.org")).alias("email"), F.lit("dev, mail b@y.org").alias("bio"), F.lit("@Acme ").alias("company"), F.lit("x.example/").alias("blog"), F.lit("Here").alias("location"))
    return _scanned(d, ProfileSource(profiles, d)).drop("jobs")


query(
    "rest_scan",
    _REPOS,
    _rest_scan,
    """WITH l AS (SELECT login, language, sum(size) AS size, min(pos) AS pos FROM i WHERE NOT fork AND language IS NOT NULL GROUP BY 1, 2)
 SELECT 'github' AS source_type, 'N' || p.login AS full_name, 'u' || p.login || '@x.org/b@y.org' AS emails, 'Here' AS location_raw, 'dev, mail b@y.org' AS headline, coalesce(string_agg(language, '/' ORDER BY size DESC, pos, language), '') AS skills, 'Acme' AS company, 'dev, mail b@y.org' AS title,
 'github=https://github.com/' || p.login || '/portfolio=https://x.example' AS links FROM (SELECT DISTINCT login FROM i) p LEFT JOIN l ON l.login = p.login WHERE p.login::INTEGER % 4 <> 0 GROUP BY p.login""",
)

# ---- identity

query("identity_email", "SELECT k, value FROM (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'user' || c_custkey || '@x.org' ELSE 'Ü' || c_name END AS value FROM {customer} UNION ALL SELECT 1000000000 + s_suppkey AS k, s_name AS value FROM {supplier}) u", lambda d: d.select("k", hash_id(F.col("value")).alias("id"), uuid5_id(F.col("value")).alias("named")), "SELECT k, substr(sha256(value), 1, 16) AS id, substr(sha1(from_hex('6ba7b8109dad11d180b400c04fd430c8') || encode(value)), 1, 12) || '5' || substr(sha1(from_hex('6ba7b8109dad11d180b400c04fd430c8') || encode(value)), 14, 3) AS named FROM i")
_WHO = "SELECT c_custkey AS k, CASE c_custkey % 5 WHEN 0 THEN 'B' || c_custkey || '+tag@gmail.com' WHEN 1 THEN 'zz@x.org' WHEN 2 THEN 'bad' ELSE NULL END AS e1, CASE WHEN c_custkey % 5 = 1 THEN 'aa' || c_custkey || '@x.org' ELSE NULL END AS e2, CASE c_custkey % 5 WHEN 3 THEN NULL ELSE 'Anna ' || c_mktsegment END AS name, CASE WHEN c_custkey % 10 < 5 THEN '415555' || lpad(cast(c_custkey AS string), 4, '0') ELSE NULL END AS phone FROM {customer}"


def _raw_people(d: DataFrame) -> DataFrame:
    some = lambda *c: F.filter(F.array(*c), lambda x: x.isNotNull())
    return d.select("k", *raw_columns(source_id=F.lit("csv:x"), source_type=F.lit("csv"), extracted_at=F.lit("2024-01-02T03:04:05").cast("timestamp_ntz"), full_name=F.col("name"), emails=some("e1", "e2"), phones=some("phone"), src_idx=F.lit(0), row_idx=F.col("k")))


_U5 = lambda k: f"substr(sha1(from_hex('6ba7b8109dad11d180b400c04fd430c8') || encode({k})), 1, 12) || '5' || substr(sha1(from_hex('6ba7b8109dad11d180b400c04fd430c8') || encode({k})), 14, 3)"
query(
    "identity_fallback",
    _WHO,
    lambda d: with_identity(_raw_people(d)).select("k", "candidate_id"),
    f"""WITH w AS (SELECT k, CASE k % 5 WHEN 0 THEN 'b' || k || '@gmail.com' WHEN 1 THEN 'aa' || k || '@x.org' END AS e, CASE WHEN name IS NULL THEN NULL ELSE lower(name) END AS n, CASE WHEN phone IS NULL THEN NULL ELSE '+1' || phone END AS p FROM i)
 SELECT k, CASE WHEN e IS NOT NULL THEN substr(sha256(e), 1, 16) WHEN n IS NOT NULL AND p IS NOT NULL THEN {_U5("n || ':' || p")} WHEN n IS NOT NULL THEN {_U5('n')} ELSE {_U5("'unknown:csv:x:2024-01-02T03:04:05'")} END AS candidate_id FROM w""",
)

# ---- merge, score, projection and validation, over three sources that tell of the same customers

_THREE = """SELECT 0 AS s, c_custkey AS k, 'user' || c_custkey || '@example.com' AS e1, NULL AS e2, '(415) 555-' || lpad(cast(c_custkey % 10000 AS string), 4, '0') AS phone, 'anna BERG' || lower(c_mktsegment) AS name, 'Head ' || c_name AS headline, 'Austin, TX' AS place, 'Python;js;' || c_mktsegment AS skills, 'Acme ' || c_nationkey AS company, 'Dev' AS title, '2019-01' AS start_, 'U ' || c_nationkey AS school, 2000 + c_nationkey AS year, 'https://linkedin.com/in/u' || c_custkey AS link FROM {customer}
 UNION ALL SELECT 1, c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'USER' ELSE 'user' END || c_custkey || '@example.com', NULL, '+1 415 555 ' || lpad(cast((c_custkey + c_custkey % 2) % 10000 AS string), 4, '0'), 'Berg' || lower(c_mktsegment) || ', Anna', CASE WHEN c_custkey % 2 = 0 THEN 'Chief ' || c_name ELSE NULL END, CASE WHEN c_custkey % 4 = 0 THEN 'Remote' ELSE 'paris, UK' END, 'JavaScript;Go', 'ACME  ' || c_nationkey, 'dev', CASE WHEN c_custkey % 2 = 0 THEN 'Jan 2019' ELSE 'March 2020 - Present' END, 'u ' || c_nationkey, 2000 + c_nationkey + c_custkey % 2, 'HTTP://LinkedIn.com/in/u' || c_custkey || '/' FROM {customer} WHERE c_custkey % 5 <> 4
 UNION ALL SELECT 2, c_custkey, 'user' || c_custkey || '@example.com', CASE WHEN c_custkey % 4 = 0 THEN 'z' || c_custkey || '@example.org' ELSE NULL END, NULL, CASE WHEN c_custkey % 5 = 0 THEN 'Annie Berg' ELSE NULL END, NULL, NULL, 'Rust;js', NULL, NULL, NULL, NULL, NULL, 'https://github.com/u' || c_custkey FROM {customer} WHERE c_custkey % 2 = 0"""
#: What the sources of _THREE are called, in DuckDB SQL: type and priority by s, and the place in ascending order of priority.
_SRC, _PRIO = "CASE s WHEN 0 THEN 'csv:x' WHEN 1 THEN 'ats_json:x' ELSE 'github:x' END", "CASE s WHEN 0 THEN 0.85 WHEN 1 THEN 0.88 ELSE 0.75 END::DOUBLE"


def three(d: DataFrame) -> DataFrame:
    """RAW rows of _THREE's."""
    some = lambda *c: F.filter(F.array(*c), lambda x: x.isNotNull())
    kinds, s = ("csv", "ats_json", "github"), F.col("s")
    kind = F.when(s == 0, kinds[0]).when(s == 1, kinds[1]).otherwise(kinds[2])
    none = F.lit(None).cast("string")
    job = F.struct(F.col("company"), F.col("title"), F.col("start_").alias("start"), none.alias("end"), F.lit(False).alias("is_current"), none.alias("summary"))
    school = F.struct(F.col("school").alias("institution"), none.alias("degree"), none.alias("field"), F.col("year").cast("string").alias("end_year"))
    given = dict(
        source_id=F.concat(kind, F.lit(":x")), source_type=kind, extracted_at=F.lit("2024-01-02T03:04:05").cast("timestamp_ntz"), full_name=F.col("name"), emails=some("e1", "e2"), phones=some("phone"), location_raw=F.col("place"), headline=F.col("headline"),
        skills_raw=split_skills(F.col("skills")), experience=F.when(F.col("company").isNotNull(), F.array(job)), education=F.when(F.col("school").isNotNull(), F.array(school)), links=F.array(F.struct(F.lit("x").alias("type"), F.col("link").alias("url"))), src_idx=s, row_idx=F.col("k"),
    )
    return spread(d, "s", "k").select(*raw_columns(**given))


_ID = "substr(sha256('user' || k || '@example.com'), 1, 16)"
#: Options of the scalar fields: k, s, field, value, conf (not rounded), source, ord.
_OPTIONS = f"""o0 AS (SELECT k, s, {_SRC} AS source, {_PRIO} AS p, CASE s WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS ord, * EXCLUDE (k, s) FROM i),
 options AS (
  SELECT k, 'full_name' AS field, CASE s WHEN 0 THEN 'Anna ' || {cap_("substr(name, 6)")} WHEN 1 THEN 'Anna ' || {cap_("split_part(name, ',', 1)")} ELSE name END AS value, CASE s WHEN 1 THEN 0.9 ELSE 1.0 END * p AS conf, source, ord FROM o0 WHERE name IS NOT NULL
  UNION ALL SELECT k, 'location', CASE s WHEN 0 THEN 'Austin, TX, US' ELSE 'Paris, GB' END, CASE s WHEN 0 THEN 0.95 ELSE 0.9 END * p, source, ord FROM o0 WHERE place IS NOT NULL AND place <> 'Remote'
  UNION ALL SELECT k, 'headline', headline, 0.7::DOUBLE * p, source, ord FROM o0 WHERE headline IS NOT NULL),
 won AS (SELECT *, first_value(value) OVER w AS best, first_value(source) OVER w AS winner, count(*) OVER (PARTITION BY k, field) AS n FROM options WINDOW w AS (PARTITION BY k, field ORDER BY conf DESC, ord))"""
#: E-mails and phones: k, field, value, conf, source, ord; the first of equal values stays.
_MULTI = """multi0 AS (SELECT k, 'emails' AS field, lower(e1) AS value, 1.0 * p AS conf, source, ord, 0 AS pos FROM o0 UNION ALL SELECT k, 'emails', e2, p, source, ord, 1 FROM o0 WHERE e2 IS NOT NULL
  UNION ALL SELECT k, 'phones', '+1' || right(regexp_replace(phone, '\\D', '', 'g'), 10), CASE s WHEN 0 THEN 0.5 ELSE 0.6 END * p, source, ord, 0 FROM o0 WHERE phone IS NOT NULL),
 multi AS (SELECT * FROM multi0 QUALIFY row_number() OVER (PARTITION BY k, field, value ORDER BY ord, pos) = 1)"""
_FACTS = f"""prov AS (SELECT k, field, source, value, {round_('conf')} AS confidence, false AS conflict, NULL AS why FROM multi
  UNION ALL SELECT k, field, source, value, {round_('conf')}, n > 1 AND source <> winner, CASE WHEN n > 1 AND source <> winner THEN 'source_priority:' || winner || '_wins' END FROM won)"""
_MERGE = f"{_OPTIONS}, {_MULTI}, {_FACTS}"


def merged_query(name: str, select, oracle: str) -> None:
    query(name, _THREE, lambda d: select(merge(three(d))), oracle)


merged_query("merge_scalar", lambda m: m.select("candidate_id", "full_name", "headline", F.concat_ws(", ", "location.city", "location.region", "location.country").alias("place")), f"WITH {_OPTIONS} SELECT {_ID} AS candidate_id, max(best) FILTER (WHERE field = 'full_name') AS full_name, max(best) FILTER (WHERE field = 'headline') AS headline, coalesce(max(best) FILTER (WHERE field = 'location'), '') AS place FROM won GROUP BY k")
merged_query("merge_emails_phones", lambda m: m.select("candidate_id", F.array_join("emails", ",").alias("emails"), F.array_join("phones", ",").alias("phones"), F.array_join("sources_ingested", ",").alias("sources")), f"WITH {_OPTIONS}, {_MULTI}, u AS (SELECT k, string_agg(value, ',' ORDER BY value) FILTER (WHERE field = 'emails') AS emails, string_agg(value, ',' ORDER BY value) FILTER (WHERE field = 'phones') AS phones FROM multi GROUP BY k) SELECT {_ID} AS candidate_id, emails, phones, (SELECT string_agg(source, ',' ORDER BY s) FROM o0 WHERE o0.k = u.k) AS sources FROM u")
_PROV = "{candidate_id} AS candidate_id, field, source, value AS normalized_value, confidence, conflict, why AS conflict_resolution FROM prov".replace("{candidate_id}", _ID)
_SHOWN = ("candidate_id", "field", "source", "normalized_value", "confidence", "conflict", "conflict_resolution")
merged_query("provenance", lambda m: fact_rows.facts(m).select(*_SHOWN), f"WITH {_MERGE} SELECT {_PROV}")
merged_query("conflicts", lambda m: fact_rows.conflicts(fact_rows.facts(m)).select(*_SHOWN), f"WITH {_MERGE} SELECT {_PROV} WHERE conflict")
merged_query("prov_by_field", lambda m: fact_rows.for_field(fact_rows.facts(m), "full_name").select(*_SHOWN), f"WITH {_MERGE} SELECT {_PROV} WHERE field = 'full_name'")
merged_query("prov_by_source", lambda m: fact_rows.for_source(fact_rows.facts(m), "github:x").select(*_SHOWN), f"WITH {_MERGE} SELECT {_PROV} WHERE source = 'github:x'")
merged_query("low_conf", lambda m: fact_rows.low_confidence(fact_rows.facts(m)).select(*_SHOWN), f"WITH {_MERGE} SELECT {_PROV} WHERE confidence < 0.6")
_SKILL_CTES = rf"""sk0 AS (SELECT k, p, source, ord, s, unnest(string_split(skills, ';')) AS raw, generate_subscripts(string_split(skills, ';'), 1) AS pos FROM o0),
 sk1 AS ({skill_sql('raw', 'sk0')}),
 sk2 AS (SELECT k, value, max(conf * p * CASE s WHEN 2 THEN 0.85 ELSE 1.0 END) AS top, min(ord * 100 + pos) AS o FROM sk1 WHERE value <> '' GROUP BY 1, 2),
 sk3 AS (SELECT k, value, o, {round_('top')} AS confidence FROM sk2),
 sk4 AS (SELECT k, string_agg(value || '=' || confidence, ';' ORDER BY confidence DESC, o) AS skills, sum(confidence) AS total, count(*) AS n, list(confidence ORDER BY confidence DESC, o) AS each FROM sk3 GROUP BY k)"""
merged_query("merge_skills", lambda m: m.select("candidate_id", F.array_join(F.transform("skills", lambda s: F.concat_ws("=", s["name"], s["confidence"].cast("string"))), ";").alias("skills")), f"WITH {_OPTIONS}, {_SKILL_CTES} SELECT {_ID} AS candidate_id, skills FROM sk4")
merged_query("merge_links", lambda m: m.select("candidate_id", "links.linkedin", "links.github", F.array_join("links.other", ",").alias("other")), f"SELECT {_ID} AS candidate_id, 'https://linkedin.com/in/u' || k AS linkedin, CASE WHEN k % 2 = 0 THEN 'https://github.com/u' || k END AS github, CASE WHEN k % 5 <> 4 THEN 'https://linkedin.com/in/u' || k ELSE '' END AS other FROM (SELECT DISTINCT k FROM i)")
merged_query("experience_dedup", lambda m: m.select("candidate_id", F.array_join(F.transform("experience", lambda e: F.concat_ws("|", e["company"], e["title"], e["start"], e["source"])), ";").alias("jobs")), f"SELECT {_ID} AS candidate_id, CASE WHEN k % 5 = 4 THEN c || '|Dev|2019-01|csv:x' WHEN k % 2 = 0 THEN c || '|Dev|2019-01|csv:x,ats_json:x' ELSE d || '|dev|2020-03|ats_json:x;' || c || '|Dev|2019-01|csv:x' END AS jobs FROM (SELECT k, max(company) FILTER (WHERE s = 0) AS c, max(company) FILTER (WHERE s = 1) AS d FROM i GROUP BY k)")
merged_query("education_dedup", lambda m: m.select("candidate_id", F.array_join(F.transform("education", lambda e: F.concat_ws("|", e["institution"], e["end_year"].cast("string"), e["source"])), ";").alias("schools")), f"SELECT {_ID} AS candidate_id, CASE WHEN k % 5 = 4 OR k % 2 = 0 THEN c || '|' || y || '|csv:x' ELSE d || '|' || (y + 1) || '|ats_json:x;' || c || '|' || y || '|csv:x' END AS schools FROM (SELECT k, max(school) FILTER (WHERE s = 0) AS c, max(school) FILTER (WHERE s = 1) AS d, max(year) FILTER (WHERE s = 0) AS y FROM i GROUP BY k)")
_AVG = lambda f, bonus: f"least(coalesce(list_sum(list(confidence ORDER BY ord) FILTER (WHERE field = '{f}')) / count(*) FILTER (WHERE field = '{f}'), 0) * CASE WHEN {bonus} AND count(DISTINCT source) FILTER (WHERE field = '{f}') > 1 THEN 1.05 ELSE 1.0 END, 1.0)"
merged_query(
    "score",
    lambda m: with_score(m).select("candidate_id", "overall_confidence"),
    f"""WITH {_MERGE}, {_SKILL_CTES}, po AS (SELECT p.*, o0.ord FROM prov p JOIN o0 ON o0.k = p.k AND o0.source = p.source),
 f AS (SELECT k, {_AVG('emails', 'true')} AS a, {_AVG('full_name', 'true')} AS b, {_AVG('phones', 'true')} AS c, {_AVG('location', 'false')} AS d, {_AVG('headline', 'false')} AS e FROM po GROUP BY k)
 SELECT {_ID} AS candidate_id, {round_(f"a * {WEIGHTS['emails']} + b * {WEIGHTS['full_name']} + c * {WEIGHTS['phones']} + least(total / n, 1.0) * {WEIGHTS['skills']} + 0.7 * {WEIGHTS['experience']} + d * {WEIGHTS['location']} + e * {WEIGHTS['headline']}")} AS overall_confidence FROM f JOIN sk4 USING (k)""",
)


def view_query(name: str, fields: list[dict], oracle: str, policy: str = "null", errors: bool = False) -> None:
    """A projection of merged candidates: candidate_id, the targets as text, and the JSON text where omission matters."""
    config = parse_config({"fields": fields, "provenance": False, "confidence": False, "missing_value_policy": policy})

    def select(m: DataFrame) -> DataFrame:
        got = project(m, config)
        if errors:
            return got.select("candidate_id", F.array_join("_errors", ",").alias("errors"), F.col("_json").alias("json"))
        shown = [c for c in got.columns if c not in ("candidate_id", "_errors", "_json", "_first")]
        kinds = dict(got.dtypes)
        text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), "/", "null") if kinds[c].startswith("array") else F.col(c).cast("string")
        return got.select("candidate_id", *[text(c).alias(c) for c in shown])

    merged_query(name, select, oracle)


_ONCE = "(SELECT DISTINCT k FROM i)"
view_query("proj_path", [{"source": "emails[0]", "target": "a"}, {"source": "emails[7]", "target": "b"}, {"source": "location.city", "target": "c"}, {"source": "skills[*].name", "target": "d"}, {"source": "experience[0].title", "target": "e"}, {"source": "nowhere.x", "target": "f"}], f"WITH {_OPTIONS}, {_SKILL_CTES}, n AS (SELECT k, string_agg(value, '/' ORDER BY confidence DESC, o) AS d FROM sk3 GROUP BY k) SELECT {_ID} AS candidate_id, 'user' || k || '@example.com' AS a, NULL::VARCHAR AS b, split_part(max(best) FILTER (WHERE field = 'location'), ',', 1) AS c, any_value(d) AS d, CASE WHEN k % 5 <> 4 AND k % 2 = 1 THEN 'dev' ELSE 'Dev' END AS e, NULL::VARCHAR AS f FROM won JOIN n USING (k) GROUP BY k")
_OPS = {"gt": (">", "0.8"), "lt": ("<", "0.8"), "ge": (">=", "0.85"), "le": ("<=", "0.85"), "eq": ("=", "0.85"), "ne": ("!=", "0.85")}
for _key, (_op, _bound) in _OPS.items():
    view_query(f"proj_filter_{_key}", [{"source": "skills", "target": "s", "filter": f"confidence {_op} {_bound}", "transform": "pluck:name"}], f"WITH {_OPTIONS}, {_SKILL_CTES}, n AS (SELECT k, string_agg(value, '/' ORDER BY confidence DESC, o) AS s FROM sk3 WHERE confidence {_op} {_bound} GROUP BY k) SELECT {_ID} AS candidate_id, s FROM {_ONCE} LEFT JOIN n USING (k)")
view_query("proj_filter_text", [{"source": "experience", "target": "s", "filter": "title = Dev", "transform": "pluck:start"}], f"SELECT {_ID} AS candidate_id, '2019-01' AS s FROM {_ONCE}")
_H = f"WITH {_OPTIONS}, h AS (SELECT k, max(best) FILTER (WHERE field = 'headline') AS h, max(best) FILTER (WHERE field = 'full_name') AS n FROM won GROUP BY k)"
_TRANSFORMS = {
    "upper": ("headline", "upper", "upper(h)"), "lower": ("headline", "lower", "lower(h)"), "truncate": ("headline", "truncate:4", "substr(h, 1, 4)"), "truncate_null": ("years_experience", "truncate:4", "''"), "join": ("emails", "join:; ", "'user' || k || '@example.com' || CASE WHEN k % 4 = 0 THEN '; z' || k || '@example.org' ELSE '' END"),
    "first": ("emails", "first", "'user' || k || '@example.com'"), "count": ("emails", "count", "CASE WHEN k % 4 = 0 THEN '2' ELSE '1' END"), "bool": ("years_experience", "bool_from_path", "'false'"), "pluck": ("education", "pluck:degree", "array_to_string(list_transform(range(CASE WHEN k % 5 = 4 OR k % 2 = 0 THEN 1 ELSE 2 END), lambda x: 'null'), '/')"),
    "round": ("provenance[0].confidence", "round:3", "CASE WHEN k % 2 = 0 THEN '0.75' ELSE '0.85' END"), "map_range": ("education[0].end_year", "map_range:[1990,2005]=Old,[2005,2015]=Mid,[2015,]=New", "CASE WHEN y < 2005 THEN 'Old' WHEN y < 2015 THEN 'Mid' ELSE 'New' END"),
}
for _key, (_source, _how, _want) in _TRANSFORMS.items():
    _from = "(SELECT k, h, n, (SELECT max(year) FROM i WHERE i.k = h.k AND s < 2) AS y FROM h) h"
    view_query(f"transform_{_key}", [{"source": _source, "target": "v", "transform": _how}], f"{_H} SELECT {_ID} AS candidate_id, {_want} AS v FROM {_from}")
_NONE_OR_LINKS = "CASE WHEN k % 2 = 0 THEN '' ELSE 'links.github' END"
_MISSING = [{"source": "full_name", "target": "who.name"}, {"source": "location.city", "target": "who.city"}, {"source": "links.github", "target": "code"}, {"source": "phones", "target": "tel", "transform": "join:,", "missing_policy": "null"}]
_JSON = "'{\"candidate_id\":\"' || @id || '\",\"who\":{\"name\":\"' || n || '\",\"city\":\"' || split_part(c, ',', 1) || '\"}' || @code || ',\"tel\":\"' || tel || '\"}'"
_M = f"WITH {_MERGE}, h AS (SELECT k, max(best) FILTER (WHERE field = 'full_name') AS n, max(best) FILTER (WHERE field = 'location') AS c FROM won GROUP BY k), g AS (SELECT k, string_agg(value, ',' ORDER BY value) AS tel FROM multi WHERE field = 'phones' GROUP BY k)"
for _policy, _code in {"null": "CASE WHEN k % 2 = 0 THEN ',\"code\":\"https://github.com/u' || k || '\"' ELSE ',\"code\":null' END", "omit": "CASE WHEN k % 2 = 0 THEN ',\"code\":\"https://github.com/u' || k || '\"' ELSE '' END", "error": "CASE WHEN k % 2 = 0 THEN ',\"code\":\"https://github.com/u' || k || '\"' ELSE ',\"code\":null' END"}.items():
    view_query(f"proj_missing_{_policy}", _MISSING, f"{_M} SELECT {_ID} AS candidate_id, {_NONE_OR_LINKS if _policy == 'error' else "''"} AS errors, {_JSON.replace('@id', _ID).replace('@code', _code)} AS json FROM h JOIN g USING (k)", _policy, True)

_BAD = "SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN '' ELSE 'id' || c_custkey END AS candidate_id, CASE c_custkey % 3 WHEN 0 THEN 'a@b@c.de' ELSE 'ok@x.org' END AS e, CASE c_custkey % 5 WHEN 0 THEN '555' ELSE '+14155550101' END AS p, CASE c_custkey % 7 WHEN 0 THEN 'USA' ELSE 'US' END AS country, c_acctbal / 1000 AS c, CASE c_custkey % 6 WHEN 0 THEN '2022-01' ELSE '2019-01' END AS a, '2020-05' AS b, 2020 + c_custkey % 20 AS y FROM {customer}"


def _validated(d: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    shaped = d.select("k", "candidate_id", F.array("e").alias("emails"), F.array("p").alias("phones"), F.struct(none.alias("city"), none.alias("region"), F.col("country")).alias("location"), F.col("c").cast("double").alias("overall_confidence"), F.array(F.struct(F.lit("Acme").alias("company"), F.lit("Dev").alias("title"), F.col("a").alias("start"), F.col("b").alias("end"))).alias("experience"), F.array(F.struct(F.lit("U").alias("institution"), F.col("y").cast("int").alias("end_year"))).alias("education"))
    return shaped.select("k", schema_errors(shaped).alias("e"), semantic_warnings(shaped, YEAR).alias("w"))


query("validate_schema", _BAD, lambda d: _validated(d).select("k", F.array_join("e", "; ").alias("errors")), "SELECT k, concat_ws('; ', CASE WHEN candidate_id = '' THEN '[candidate_id] must be a non-empty string' END, CASE WHEN k % 3 = 0 THEN '[emails.0] has invalid format' END, CASE WHEN k % 5 = 0 THEN '[phones.0] has invalid format' END, CASE WHEN country = 'USA' THEN '[location.country] must be ISO-3166 alpha-2' END, CASE WHEN c NOT BETWEEN 0 AND 1 THEN '[overall_confidence] must be a number between 0 and 1' END) AS errors FROM i")
query("validate_semantic", _BAD, lambda d: _validated(d).select("k", F.array_join("w", "; ").alias("warnings")), f"SELECT k, concat_ws('; ', CASE WHEN a > b THEN 'Invalid date range for Acme: start=' || a || ' > end=' || b END, CASE WHEN y > {YEAR + 10} THEN 'Suspicious future education year ' || y || ' at U' END, CASE WHEN p = '555' THEN 'Phone not in E.164 format: 555' END) AS warnings FROM i")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged, scored and projected candidates."""
    return with_score(merge(three(rows(spark, sf_dir, _THREE)))).select("candidate_id", "full_name", F.array_join("emails", ",").alias("emails"), F.array_join("phones", ",").alias("phones"), "overall_confidence")




def _whole(m: DataFrame) -> DataFrame:
    """All stages, with the default view."""
    shown = project(with_score(m), parse_config({}))
    shown = shown.withColumns({"_invalid": schema_errors(shown), "_warnings": semantic_warnings(shown, YEAR)})
    joined = lambda c: F.array_join(c, ";")
    return shown.select(
        "candidate_id", "full_name", joined("emails").alias("emails"), joined("phones").alias("phones"), F.concat_ws(", ", "location.city", "location.region", "location.country").alias("place"), "headline", "links.linkedin", "links.github",
        joined(F.transform("skills", lambda x: F.concat_ws("=", x["name"], x["confidence"].cast("string")))).alias("skills"), "overall_confidence", F.size("provenance").cast("bigint").alias("entries"), joined("sources_ingested").alias("sources"), joined("_invalid").alias("errors"), joined("_warnings").alias("warnings"),
    )


_SCORE = f"{round_(f'a * {WEIGHTS["emails"]} + b * {WEIGHTS["full_name"]} + c * {WEIGHTS["phones"]} + least(total / n, 1.0) * {WEIGHTS["skills"]} + 0.7 * {WEIGHTS["experience"]} + d * {WEIGHTS["location"]} + e * {WEIGHTS["headline"]}')}"
merged_query(
    "pipeline_full",
    _whole,
    f"""WITH {_MERGE}, {_SKILL_CTES}, po AS (SELECT p.*, o0.ord FROM prov p JOIN o0 ON o0.k = p.k AND o0.source = p.source),
 f AS (SELECT k, {_AVG('emails', 'true')} AS a, {_AVG('full_name', 'true')} AS b, {_AVG('phones', 'true')} AS c, {_AVG('location', 'false')} AS d, {_AVG('headline', 'false')} AS e, count(*) AS entries FROM po GROUP BY k),
 h AS (SELECT k, max(best) FILTER (WHERE field = 'full_name') AS full_name, max(best) FILTER (WHERE field = 'headline') AS headline, coalesce(max(best) FILTER (WHERE field = 'location'), '') AS place FROM won GROUP BY k),
 u AS (SELECT k, string_agg(value, ';' ORDER BY value) FILTER (WHERE field = 'emails') AS emails, string_agg(value, ';' ORDER BY value) FILTER (WHERE field = 'phones') AS phones FROM multi GROUP BY k),
 g AS (SELECT k, string_agg(source, ';' ORDER BY s) AS sources FROM o0 GROUP BY k)
 SELECT {_ID} AS candidate_id, full_name, emails, phones, place, headline, 'https://linkedin.com/in/u' || k AS linkedin, CASE WHEN k % 2 = 0 THEN 'https://github.com/u' || k END AS github, skills, {_SCORE} AS overall_confidence, entries::BIGINT AS entries, sources, '' AS errors, '' AS warnings
 FROM f JOIN sk4 USING (k) JOIN h USING (k) JOIN u USING (k) JOIN g USING (k)""",
)
_CUSTOM = [{"source": "full_name", "target": "candidate_name", "required": True}, {"source": "emails[0]", "target": "primary_email", "required": True}, {"source": "phones", "target": "phone_numbers", "transform": "join:; "}, {"source": "links.github", "target": "github_url"}, {"source": "skills", "target": "technical_skills", "filter": "confidence > 0.65", "transform": "pluck:name"}]
view_query("pipeline_custom", _CUSTOM, f"WITH {_MERGE}, {_SKILL_CTES}, h AS (SELECT k, max(best) AS n FROM won WHERE field = 'full_name' GROUP BY k), g AS (SELECT k, string_agg(value, '; ' ORDER BY value) AS tel FROM multi WHERE field = 'phones' GROUP BY k), t AS (SELECT k, string_agg('\"' || value || '\"', ',' ORDER BY confidence DESC, o) AS t FROM sk3 WHERE confidence > 0.65 GROUP BY k) SELECT {_ID} AS candidate_id, '' AS errors, '{{\"candidate_id\":\"' || {_ID} || '\",\"candidate_name\":\"' || n || '\",\"primary_email\":\"user' || k || '@example.com\",\"phone_numbers\":\"' || tel || '\"' || CASE WHEN k % 2 = 0 THEN ',\"github_url\":\"https://github.com/u' || k || '\"' ELSE '' END || ',\"technical_skills\":[' || t || ']}}' AS json FROM h JOIN g USING (k) JOIN t USING (k)", "omit", True)
