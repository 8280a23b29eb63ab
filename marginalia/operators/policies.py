"""Policies that contradict each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import policy_part

#: X must [not] VERB Y [for Z], over lines if need be: subject, strength, not, verb, value, purpose.
POLICY_OF_ANY_VERB = r"(?is)^\s*(.+?)\s+(must|should|shall|needs\s+to|required\s+to)\s+(not\s+)?(\w+)\s+(.+?)(?:\s+(?:within|for|before|during)\s+(.+?))?\s*[.!]?\s*\z"


def policy_conflicts(claims: DataFrame, text: str = "claim_text") -> DataFrame:
    """Contradictions among the policies of a scope: ``scope, subject, verb, purpose, kind, value, options, in_favour, against, severity``.

    Policies are compared if subject, verb and purpose are the same (none is a
    purpose of its own). ``opposite``: a value that some ask for and others forbid, one row
    per value. ``different``: two or more values (``options``) that are asked for, one row for
    all of them, without ``value``. High severity if any of its policies is more than a
    "should". Counts of a value are taken before anything is compared, so a hot subject is
    one row per value. Null texts and those that are no policies are ignored; a null scope is a scope.
    """
    g = lambda i: F.regexp_extract(text, POLICY_OF_ANY_VERB, i)
    p = claims.where(F.col(text).rlike(POLICY_OF_ANY_VERB)).select(
        "scope", policy_part(g(1)).alias("subject"), F.lower(g(4)).alias("verb"), policy_part(g(6)).alias("purpose"), policy_part(g(5)).alias("value"),
        (F.trim(g(3)) != "").alias("negated"), (F.lower(g(2)) != "should").alias("hard"),
    )
    key = ["scope", "subject", "verb", "purpose"]
    per = p.where("subject <> '' AND value <> ''").groupBy(*key, "value").agg(
        F.count_if(~F.col("negated")).alias("in_favour"), F.count_if("negated").alias("against"), F.bool_or("hard").alias("hard"), F.bool_or(F.col("hard") & ~F.col("negated")).alias("hard_in_favour")
    )
    severity = lambda c: F.when(c, "high").otherwise("medium").alias("severity")
    opposite = per.where("in_favour > 0 AND against > 0").select(*key, F.lit("opposite").alias("kind"), "value", F.lit(1).cast("bigint").alias("options"), "in_favour", "against", severity(F.col("hard")))
    different = per.where("in_favour > 0").groupBy(*key).agg(F.count("*").alias("options"), F.sum("in_favour").alias("in_favour"), F.bool_or("hard_in_favour").alias("hard")).where("options > 1")
    return opposite.unionByName(
        different.select(*key, F.lit("different").alias("kind"), F.lit(None).cast("string").alias("value"), "options", "in_favour", F.lit(0).cast("bigint").alias("against"), severity(F.col("hard")))
    )
