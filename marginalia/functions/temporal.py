"""Validity, freshness and refresh intervals as columns; every instant is given, never the clock's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.sources.tables import micros

DAY_US = 86_400_000_000
#: Seconds of a unit in an interval like ``@every 10m``.
UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400}


def valid_at(at: Column, valid_from: str = "valid_from", expires_at: str = "expires_at") -> Column:
    """Whether a row holds at an instant: start inclusive, end exclusive, either may be open."""
    a, b = F.col(valid_from), F.col(expires_at)
    return (a.isNull() | (a <= at)) & (b.isNull() | (b > at))


def freshness(at: Column, verified: str, expires: str = "expires_at", due: Column | None = None, inclusive: bool = True, days: int = 120) -> Column:
    """expired, stale, unknown or fresh at an instant. With ``inclusive`` a row is expired from its expiry on, else only after it.

    ``due`` marks rows whose source should have been read again: stale.
    """
    over = F.col(expires) <= at if inclusive else F.col(expires) < at
    old = micros(verified) < micros(at) - F.lit(days * DAY_US)
    return (
        F.when(over, "expired")
        .when(due if due is not None else F.lit(False), "stale")
        .when(F.col(verified).isNull(), "unknown")
        .when(old, "stale")
        .otherwise("fresh")
    )


def freshness_rank(c: Column) -> Column:
    return F.when(c == "fresh", 0).when(c == "stale", 2).when(c == "expired", 3).otherwise(1)


def policy_seconds(policy: Column) -> Column:
    """Seconds of the first usable ``max_age_*`` of a policy in JSON, else null."""
    out = F.lit(None).cast("bigint")
    for name, unit in reversed([("seconds", 1), ("minutes", 60), ("hours", 3600), ("days", 86400)]):
        v = F.get_json_object(policy, f"$.max_age_{name}")
        out = F.when(v.rlike("^[1-9][0-9]*$"), v.try_cast("bigint") * unit).otherwise(out)
    return out


def schedule_seconds(cron: Column) -> Column:
    """Seconds between runs of ``@hourly``, ``@daily`` or ``@every N[smhd]``, else null."""
    n = F.regexp_extract(cron, r"^@every\s+([1-9][0-9]*)([smhd])$", 1).try_cast("bigint")
    unit = F.regexp_extract(cron, r"^@every\s+([1-9][0-9]*)([smhd])$", 2)
    by = F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400)
    return F.when(cron == "@hourly", 3600).when(cron == "@daily", 86400).otherwise(n * by)


def instant(text: Column) -> Column:
    """The instant that a text names in UTC: RFC 3339 with seconds and ``Z``, or a date; null if it is neither."""
    t = F.trim(text)
    whole = F.when(t.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,6})?Z$"), F.regexp_replace(F.regexp_replace(t, "T", " "), "Z$", ""))
    return F.coalesce(whole, F.when(t.rlike(r"^\d{4}-\d\d-\d\d$"), t)).try_cast("timestamp_ntz")
