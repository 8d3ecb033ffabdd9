"""Developer profiles fetched from a REST service.

Large runs read landed payloads: a table of profiles and a table of repositories. `Fetcher` gets the payloads of a few logins
itself, with retries, by any client (`http_get` is one).
"""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import people, urls
from ..functions.core import strip
from ..schemas import raw_columns
from .base import Source

#: Waits between attempts in seconds, time-out, and how many repositories a profile is asked for.
WAITS, TIMEOUT, REPOSITORIES = (1, 2, 4), 10, 30


def languages(repos: DataFrame) -> DataFrame:
    """login, language, size and first place: sizes summed over repositories that are no forks. repos: login, pos, language, size, fork."""
    own = repos.where(~F.coalesce(F.col("fork"), F.lit(False)) & F.col("language").isNotNull())
    return own.groupBy("login", "language").agg(F.sum(F.coalesce(F.col("size"), F.lit(0))).cast("bigint").alias("size"), F.min("pos").alias("pos"))


class ProfileSource(Source):
    """profiles: login, status, name, email, bio, company, blog, location. Profiles whose status is not 200 are skipped."""

    source_type = "github"
    base_confidence = 0.75

    def __init__(self, profiles: DataFrame, repos: DataFrame):
        self.profiles, self.repos = profiles, repos
        self.source_id = "github:landed"

    def extract(self, spark, src_idx, at):
        spoken = languages(self.repos).groupBy("login").agg(F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("o"), "pos", "language"))).alias("l"))
        rows = self.profiles.where(F.coalesce(F.col("status"), F.lit(200)) == 200).join(spoken, "login", "left")
        email, bio, blog = F.lower(strip(F.col("email"))), strip(F.col("bio")), strip(F.col("blog"))
        mails = F.array_distinct(F.concat(F.filter(F.array(email), lambda e: e != ""), F.coalesce(people.raw_emails_in(F.col("bio")), F.array().cast("array<string>"))))
        site = F.when(blog == "", F.lit(None)).when(blog.startswith("http"), F.regexp_replace(blog, "/+$", "")).otherwise(F.concat(F.lit("https://"), F.regexp_replace(blog, "/+$", "")))
        company = strip(F.regexp_replace("company", "^@", ""))
        none = F.lit(None).cast("string")
        job = F.struct(company.alias("company"), F.col("bio").alias("title"), none.alias("start"), none.alias("end"), F.lit(True).alias("is_current"), none.alias("summary"))
        links = F.filter(F.array(F.struct(F.lit("github").alias("type"), F.concat(F.lit("https://github.com/"), F.col("login")).alias("url")), F.struct(F.lit("portfolio").alias("type"), site.alias("url"))), lambda x: x["url"].isNotNull())
        skills = F.coalesce(F.transform("l", lambda x: x["language"]), F.array().cast("array<string>"))
        return rows.select(
            *raw_columns(
                source_id=F.concat(F.lit("github:"), F.coalesce("login", F.lit("unknown"))),
                source_type=F.lit(self.source_type),
                extracted_at=self.stamp(at),
                base_confidence=F.lit(self.base_confidence),
                full_name=F.when(F.col("name") != "", F.col("name")),
                emails=mails,
                location_raw=F.col("location"),
                headline=F.when(bio != "", F.substring(bio, 1, 200)),
                skills_raw=skills,
                experience=F.when(company != "", F.array(job)),
                links=links,
                warnings=F.when(F.size(skills) == 0, F.array(F.lit("no_languages_found"))).otherwise(F.array().cast("array<string>")),
                src_idx=F.lit(src_idx),
                row_idx=F.monotonically_increasing_id(),
            )
        )


class Fetcher:
    """Gets a profile and its repositories as rows for ProfileSource. get(url, timeout) returns an object with status_code, headers and json()."""

    def __init__(self, get: Callable, base: str = "https://api.github.com", wait: Callable[[float], None] = time.sleep):
        self.get, self.base, self.wait = get, base, wait

    def _once(self, path: str):
        for pause in WAITS:
            try:
                answer = self.get(self.base + path, TIMEOUT)
            except OSError:
                self.wait(pause)
                continue
            if answer.status_code != 429:
                return answer
            self.wait(float(answer.headers.get("Retry-After", pause)))
        return None

    def fetch(self, login: str) -> tuple[dict | None, list[dict]]:
        answer = self._once(f"/users/{login}")
        if answer is None or answer.status_code != 200:
            return None, []
        profile = {"login": login, "status": 200} | {k: answer.json().get(k) for k in ("name", "email", "bio", "company", "blog", "location")}
        more = self._once(f"/users/{login}/repos?per_page={REPOSITORIES}&sort=pushed&type=owner")
        repos = more.json() if more is not None and more.status_code == 200 else []
        return profile, [{"login": login, "pos": k} | {c: r.get(c) for c in ("language", "size", "fork")} for k, r in enumerate(repos)]


_PROFILE = "login string, status int, name string, email string, bio string, company string, blog string, location string"
_REPO = "login string, pos int, language string, size bigint, fork boolean"


def login_of(link: str) -> str:
    """The login that a profile link or a bare login names; empty if it names none."""
    found = re.match(r"(?:https?://)?(?:www\.)?github\.com/([a-zA-Z0-9\-]+)/?", link.strip())
    login = found[1] if found else link.strip()
    return login if re.fullmatch(r"[a-zA-Z0-9\-]+", login) and login not in urls.NO_USERS else ""


def http_get(token: str | None = None) -> Callable:
    """get() for Fetcher by the standard library; answers with an error status are answers."""

    class Answer:
        def __init__(self, status: int, headers, body: bytes):
            self.status_code, self.headers, self.body = status, headers, body

        def json(self):
            return json.loads(self.body)

    def get(url: str, timeout: float) -> Answer:
        head = {"Accept": "application/vnd.github+json"} | ({"Authorization": f"Bearer {token}"} if token else {})
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=head), timeout=timeout) as answer:
                return Answer(answer.status, answer.headers, answer.read())
        except urllib.error.HTTPError as e:
            return Answer(e.code, e.headers, e.read())

    return get


def fetched(spark: SparkSession, links: list[str], fetcher: Fetcher) -> ProfileSource:
    """The source of the profiles that a few links name, fetched by the driver under the service's rate limit; links that name nobody
    and profiles that are not found are left out."""
    profiles, repos = [], []
    for login in dict.fromkeys(filter(None, map(login_of, links))):
        profile, own = fetcher.fetch(login)
        if profile:
            profiles.append(profile)
            repos += own
    return ProfileSource(spark.createDataFrame(profiles, _PROFILE), spark.createDataFrame(repos, _REPO))
