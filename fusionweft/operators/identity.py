"""Deterministic identity: one hashed key for each record, no transitive closure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import people
from ..functions.core import let

#: The DNS namespace of name-based UUIDs.
_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def hash_id(key: Column) -> Column:
    return F.substring(F.sha2(key, 256), 1, 16)


def uuid5_id(key: Column) -> Column:
    """The first 16 hexadecimal digits of the name-based (version 5) UUID of a key."""
    digest = F.sha1(F.concat(F.unhex(F.lit(_NAMESPACE)), F.encode(key, "UTF-8")))
    return F.concat(F.substring(digest, 1, 12), F.lit("5"), F.substring(digest, 14, 3))


def primary_email(normalised: Column) -> Column:
    """The smallest of the valid addresses, its alias folded afterwards."""
    least = F.array_min(normalised)  # which passes nulls over
    return let(least, lambda e: F.when(people.is_alias(e), people.base_address(e)).otherwise(e))


def iso(at: Column) -> Column:
    """A time as Python's isoformat() writes it: without a fraction where there is none."""
    whole = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    part = F.date_format(at, "SSSSSS")
    return F.when(part == "000000", whole).otherwise(F.concat(whole, F.lit("."), part))


def candidate_id(emails: Column, name: Column, phones: Column, source_id: Column, extracted_at: Column) -> Column:
    """emails and phones: arrays of normalised values (nulls where invalid); name: the normalised name."""
    phone, low = F.get(F.filter(phones, lambda p: p.isNotNull()), F.lit(0)), F.lower(name)
    # concat is null where one of its parts is
    key = F.coalesce(F.concat(low, F.lit(":"), phone), low, F.concat(F.lit("unknown:"), F.coalesce(source_id, F.lit("None")), F.lit(":"), F.coalesce(iso(extracted_at), F.lit("None"))))
    return let(primary_email(emails), lambda email: F.when(email.isNotNull(), hash_id(email)).otherwise(let(key, uuid5_id)))


def with_identity(raw: DataFrame) -> DataFrame:
    """raw with candidate_id."""
    emails = F.transform("emails", lambda e: people.email(e)["value"])
    phones = F.transform("phones", lambda p: people.phone(p)["value"])
    narrow = raw.withColumns({"_e": emails, "_p": phones, "_n": people.name(F.col("full_name"))["value"]})
    return narrow.withColumn("candidate_id", candidate_id(F.col("_e"), F.col("_n"), F.col("_p"), F.col("source_id"), F.col("extracted_at"))).drop("_e", "_p", "_n")
