"""Profile links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import let, strip
from .people import result

_PARTS = r"(?s)^(?i:https)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
#: First path parts that name no user.
NO_USERS = ("orgs", "teams", "marketplace", "features", "pricing")


def url(raw: Column) -> Column:
    """https, lower-case host, no slashes at the path's end; query and fragment stay, unless they are empty."""

    def built(u: Column) -> Column:
        secure = F.when(u.rlike(r"(?i)^https?://"), F.regexp_replace(u, r"(?i)^https?://", "https://")).otherwise(F.concat(F.lit("https://"), u))

        def joined(s: Column) -> Column:
            part = lambda k: F.regexp_extract(s, _PARTS, k)
            some = lambda p: F.when(F.length(p) > 1, p).otherwise("")
            host = part(1)
            return result(F.when((u != "") & (host != ""), F.concat(F.lit("https://"), F.lower(host), F.regexp_replace(part(2), "/+$", ""), some(part(3)), some(part(4)))), 1.0)

        return let(secure, joined)

    return let(strip(raw), built)


def classify(link: Column) -> Column:
    low = F.lower(link)
    return F.when(low.contains("linkedin.com"), "linkedin").when(low.contains("github.com"), "github").otherwise("other")


def github_user(link: Column) -> Column:
    found = F.regexp_extract(link, r"^https?://(?:www\.)?github\.com/([a-zA-Z0-9\-]+)/?", 1)
    return F.when((found != "") & ~found.isin(*NO_USERS), found)
