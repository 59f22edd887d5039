"""Fields of an audit event: user, time keys, object prefix, operation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import rules


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def user_id(arn: Column | str, principal: Column | str) -> Column:
    """Last path part of the ARN, else its last colon part, else the principal."""
    arn, principal = _col(arn), _col(principal)
    named = arn.isNotNull() & ~arn.isin("", rules.UNKNOWN_USER)
    return (
        F.when(named & arn.contains("/"), F.substring_index(arn, "/", -1))
        .when(named, F.substring_index(arn, ":", -1))
        .otherwise(F.coalesce(F.nullif(principal, F.lit("")), F.lit(rules.UNKNOWN_USER)))
    )


def parse_event_time(text: Column | str) -> Column:
    """ISO-8601 text to timestamp; null where the text is no full date."""
    text = _col(text)
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(text))


def hour_key(ts: Column | str) -> Column:
    return F.date_format(_col(ts), "yyyy-MM-dd'T'HH")


def day_key(ts: Column | str) -> Column:
    return F.date_format(_col(ts), "yyyy-MM-dd")


def minute_key(ts: Column | str) -> Column:
    return F.date_format(_col(ts), "yyyy-MM-dd HH:mm")


def object_prefix(key: Column | str) -> Column:
    """First two path parts; null for an empty key."""
    key = _col(key)
    return F.when(key != "", F.substring_index(key, "/", 2))


def s3_operation(event_name: Column | str) -> Column:
    """get / put / list by the first of the three words the name contains."""
    name = _col(event_name)
    return (
        F.when(name.contains("Get"), "get")
        .when(name.contains("Put"), "put")
        .when(name.contains("List"), "list")
    )
