"""Further mutations as pure functions from a table and what is asked for to the next table.

Each reads its tables once; keys that are asked for twice count once (the last by order, where there is one).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def replaced(rows: DataFrame, new: DataFrame, owner: str) -> DataFrame:
    """``rows`` in which all rows of the owners in ``new`` are replaced by the rows of ``new``, be they more or fewer.

    Rows of other owners and without owner stay; new rows without owner are left out. Columns are those of ``rows``.
    """
    owners = new.select(owner).where(F.col(owner).isNotNull()).distinct()
    return rows.join(owners, owner, "left_anti").select(*rows.columns).unionByName(new.where(F.col(owner).isNotNull()).select(*rows.columns))


def forgotten(claims: DataFrame, requests: DataFrame, key: str = "claim_id") -> DataFrame:
    """Claims after requests ``(key, permanent)`` to forget them: deprecated, and if any request is permanent without the tag by which they could wake.

    ``tag`` is kept by claims that are forgotten for now. Requests for unknown claims and without key do nothing.
    """
    r = requests.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.coalesce("permanent", F.lit(False))).alias("_permanent"))
    j = claims.join(r, key, "left")
    asked = F.col("_permanent").isNotNull()
    return j.withColumns({
        "status": F.when(asked, F.lit("deprecated")).otherwise(F.col("status")),
        "tag": F.when(~F.coalesce("_permanent", F.lit(False)), F.col("tag")),
    }).drop("_permanent")


def resolved(conflicts: DataFrame, verdicts: DataFrame, key: str = "conflict_id") -> DataFrame:
    """Conflicts after verdicts ``(key, to, note, at)``, the last of each by ``at``: the status, and the resolution only where it ends the conflict.

    resolved and suppressed end a conflict, with ``resolution`` and ``resolved_at``; any other status opens it again, without them.
    """
    last = verdicts.where(F.col(key).isNotNull() & F.col("to").isNotNull()).groupBy(key).agg(F.max_by(F.struct("to", "note", "at"), F.struct("at", "to")).alias("_v"))
    j = conflicts.join(last, key, "left")
    ends = F.col("_v.to").isin("resolved", "suppressed")
    asked = F.col("_v").isNotNull()
    return j.withColumns({
        "resolution": F.when(asked, F.when(ends, F.col("_v.note"))).otherwise(F.col("resolution")),
        "resolved_at": F.when(asked, F.when(ends, F.col("_v.at"))).otherwise(F.col("resolved_at")),
        "status": F.coalesce("_v.to", "status"),
    }).drop("_v")


def merged_summaries(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Summaries after newer ones of the same keys: counts and addresses are overwritten, maps of ``metadata`` merged, in which the new value holds.

    ``new`` has one row a key. Null keys equal each other.
    """
    left = old.alias("o").join(new.alias("n"), [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full")
    none = F.create_map().cast("map<string,string>")
    a, b = F.coalesce("o.metadata", none), F.coalesce("n.metadata", none)
    merged = F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k)), b)
    is_new = F.coalesce(*[F.col(f"n.{c}").isNotNull() for c in ["documents"]])
    rest = [c for c in old.columns if c not in (*keys, "metadata")]
    return left.select(*[F.coalesce(f"n.{k}", f"o.{k}").alias(k) for k in keys], *[F.when(is_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in rest], merged.alias("metadata"))


def refreshed(edges: DataFrame, summaries: DataFrame, addresses: DataFrame, address: str = "source_url") -> tuple[DataFrame, DataFrame]:
    """What a refresh of addresses begins with: their edges are deprecated, and summaries that cite any of them are gone.

    ``summaries`` has one row per summary and address that it cites, so no array of addresses is searched.
    """
    a = addresses.select(address).where(F.col(address).isNotNull()).distinct()
    hit = edges.join(a.withColumn("_hit", F.lit(True)), address, "left")
    e = hit.withColumn("status", F.when(F.col("_hit"), F.lit("deprecated")).otherwise(F.col("status"))).drop("_hit")
    gone = summaries.join(a, address, "left_semi").select("summary").distinct()
    return e, summaries.join(gone, "summary", "left_anti")


#: States of an observation that a proposal may take up, and that refuse it.
OPEN_OBSERVATIONS, CLOSED_OBSERVATIONS = ["raw", "challenged"], ["accepted", "rejected"]


def linked(observations: DataFrame, proposals: DataFrame, key: str) -> DataFrame:
    """Observations after proposals ``(key, proposal_id)`` that rest on them: open ones become proposed and name the smallest proposal; closed ones refuse.

    ``refused`` says which would have been changed. One that is proposed keeps its proposal.
    """
    p = proposals.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("proposal_id").alias("_p"))
    j = observations.join(p, key, "left")
    takes = F.col("_p").isNotNull() & F.col("status").isin(OPEN_OBSERVATIONS)
    return j.withColumns({
        "refused": F.coalesce(F.col("_p").isNotNull() & F.col("status").isin(CLOSED_OBSERVATIONS), F.lit(False)),
        "proposal_id": F.when(takes, F.col("_p")).otherwise(F.col("proposal_id")),
        "status": F.when(takes, F.lit("proposed")).otherwise(F.col("status")),
    }).drop("_p")


def source_marks(runs: DataFrame, source: str = "source") -> DataFrame:
    """What a source's runs ``(source, at, ok, drained)`` leave: ``last_success_at`` (of runs that took all there was), ``last_error_at``, ``errors_since``.

    ``errors_since``: failed runs after the last success. All by aggregation: the moments are found first, then
    the failures after them are counted. Runs without source or moment are ignored.
    """
    r = runs.where(F.col(source).isNotNull() & F.col("at").isNotNull())
    marks = r.groupBy(source).agg(F.max(F.when(F.col("ok") & F.col("drained"), F.col("at"))).alias("last_success_at"), F.max(F.when(~F.col("ok"), F.col("at"))).alias("last_error_at"))
    failed = r.where(~F.col("ok")).groupBy(source, "at").agg(F.count("*").alias("_n"))
    since = failed.join(marks.select(source, "last_success_at"), source).where(F.col("last_success_at").isNull() | (F.col("at") > F.col("last_success_at")))
    return marks.join(since.groupBy(source).agg(F.sum("_n").alias("errors_since")), source, "left").fillna({"errors_since": 0})


def backoff_seconds(attempts: Column, base: int = 30, most: int = 900) -> Column:
    """Seconds until the next attempt: ``base``, doubled with each attempt after the first, ``most`` at most; null attempts count as one."""
    doublings = F.least(F.greatest(F.coalesce(attempts, F.lit(1)) - 1, F.lit(0)), F.lit(20)).cast("int")
    return F.least(F.lit(most), F.shiftleft(F.lit(base), 0) * F.pow(F.lit(2.0), doublings)).cast("bigint")


def job_requests(jobs: DataFrame, requests: DataFrame, key: str = "job_id") -> DataFrame:
    """Jobs after requests ``(key, action)``: retry puts failed and canceled ones back with one more attempt allowed, cancel stops queued and waiting ones.

    ``done`` says whether the request could be followed; null without one. Of both requests for a job cancel counts.
    """
    r = requests.where(F.col(key).isNotNull() & F.col("action").isin("retry", "cancel")).groupBy(key).agg(F.min("action").alias("_a"))
    j = jobs.join(r, key, "left")
    again = (F.col("_a") == "retry") & F.col("status").isin("failed", "canceled")
    stop = (F.col("_a") == "cancel") & F.col("status").isin("queued", "retry")
    return j.withColumns({
        "done": F.when(F.col("_a").isNotNull(), F.coalesce(again | stop, F.lit(False))),
        "max_attempts": F.when(again, F.greatest("max_attempts", F.col("attempts") + 1)).otherwise(F.col("max_attempts")),
        "status": F.when(again, F.lit("queued")).when(stop, F.lit("canceled")).otherwise(F.col("status")),
    }).drop("_a")


def retired_code_claims(claims: DataFrame, documents: DataFrame) -> DataFrame:
    """Claims whose address is that of a document of code are deprecated; an address is looked up within the scope."""
    code = documents.where("is_code").select("scope", "source_url").where("scope is not null and source_url is not null").distinct().withColumn("_code", F.lit(True))
    j = claims.join(code, ["scope", "source_url"], "left")
    return j.withColumn("status", F.when(F.col("_code") & (F.col("status") != "deprecated"), F.lit("deprecated")).otherwise(F.col("status"))).drop("_code")
