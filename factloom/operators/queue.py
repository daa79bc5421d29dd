"""Lease queue and append-only notes, as folds over event rows: every transition is a guarded projection of the latest state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLAIMABLE = ("queued", "failed", "cancelled")


def by_urgency() -> list[Column]:
    return [F.desc("priority"), F.asc("created_at"), F.asc("id")]


def claim_next(jobs: DataFrame, now: int, holder: str, lease_ms: int) -> DataFrame:
    """The queue's head, claimed."""
    head = jobs.where("state = 'queued'").orderBy(*by_urgency()).limit(1)
    return claimed(head, now, holder, lease_ms)


def claimed(jobs: DataFrame, now: int, holder: str, lease_ms: int) -> DataFrame:
    return jobs.withColumns(
        {"state": F.lit("running"), "lease_holder": F.lit(holder), "lease_expires_at": F.lit(now + lease_ms).cast("long"), "heartbeat_at": F.lit(now).cast("long")}
    )


def submitted(jobs: DataFrame, requests: DataFrame, now: int) -> DataFrame:
    """Per request (id): acquired if it is new, or its job can be claimed or its lease has run out; settled if completed; else held."""
    j = jobs.select("id", "state", "lease_expires_at")
    out = (
        F.when(F.col("state").isNull() | F.col("state").isin(*CLAIMABLE), "acquired")
        .when(F.col("state") == "completed", "settled")
        .when((F.col("state") == "running") & (F.col("lease_expires_at") < now), "acquired")
        .otherwise("held")
    )
    return requests.select("id").distinct().join(j, "id", "left").select("id", out.alias("outcome"))


def enqueued(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """Jobs after idempotent requests (id, priority, created_at): new ones queue; a waiting one takes the last priority; others stay."""
    last = requests.groupBy("id").agg(F.max_by("priority", "created_at").alias("new_priority"), F.min("created_at").alias("asked_at"))
    rows = jobs.select("id", "state", "priority", "created_at").join(last, "id", "full")
    waiting = F.col("state").isin(*CLAIMABLE)
    return rows.select(
        "id",
        F.when(F.col("state").isNull() | (waiting & F.col("new_priority").isNotNull()), "queued").otherwise(F.col("state")).alias("state"),
        F.when(F.col("state").isNull() | waiting, F.coalesce("new_priority", "priority")).otherwise(F.col("priority")).alias("priority"),
        F.coalesce("created_at", "asked_at").alias("created_at"),
    )


def cancelled(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, applied): only queued jobs can be cancelled."""
    return ids.join(jobs.select("id", "state"), "id", "left").select("id", F.coalesce(F.col("state") == "queued", F.lit(False)).alias("applied"))


def finished(jobs: DataFrame, reports: DataFrame, now: int) -> DataFrame:
    """Outcome of finish reports (id, holder, outcome, result): only by the lease holder in time; completed needs a result."""
    rows = reports.join(jobs.select("id", "state", "lease_holder", "lease_expires_at"), "id", "left")
    verdict = (
        F.when(F.col("state").isNull(), "unknown_job")
        .when((F.col("state") != "running") | (F.col("lease_holder") != F.col("holder")), "not_lease_holder")
        .when(F.col("lease_expires_at") < now, "lease_expired")
        .when((F.col("outcome") == "completed") & F.col("result").isNull(), "result_required")
        .otherwise(F.col("outcome"))
    )
    return rows.select("id", verdict.alias("verdict"))


def reaped(jobs: DataFrame, now: int, to: str) -> DataFrame:
    """Running jobs whose lease has run out: jobs go to failed, agent requests back to queued."""
    gone = jobs.where((F.col("state") == "running") & (F.col("lease_expires_at") < now))
    return gone.select("id", F.lit(to).alias("state"), F.when(F.lit(to == "failed"), "lease_expired").alias("reason"))


def beaten(jobs: DataFrame, beats: DataFrame, now: int, lease_ms: int) -> DataFrame:
    """(id, applied, lease_expires_at) of heartbeats (id, holder): the holder of a running job renews its lease, for a second at least."""
    rows = beats.join(jobs.select("id", "state", "lease_holder", "lease_expires_at"), "id", "left")
    ok = F.coalesce((F.col("state") == "running") & (F.col("lease_holder") == F.col("holder")), F.lit(False))
    return rows.select("id", ok.alias("applied"), F.when(ok, F.lit(now + max(lease_ms, 1000)).cast("long")).otherwise(F.col("lease_expires_at")).alias("lease_expires_at"))


#: The actions that an agent may ask for.
ACTIONS = ("inspect", "annotate", "propose_patch")


def asked(requests: DataFrame, analyses: DataFrame) -> DataFrame:
    """Requests (owner, request_key, kind, analysis, created_at, seq) as they are stored: the earliest under each (owner, request_key); one for another
    action, or of an analysis that is not in ``analyses`` (analysis), is stored as rejected with the reason."""
    key = F.sha2(F.concat_ws("\u0000", "owner", "request_key"), 256)
    first = requests.groupBy(key.alias("id")).agg(F.min_by(F.struct("kind", "analysis", "created_at"), F.struct("created_at", "seq")).alias("r")).select("id", "r.*")
    rows = first.join(analyses.select("analysis", F.lit(True).alias("known")).distinct(), "analysis", "left")
    reason = F.when(~F.coalesce(F.col("kind").isin(*ACTIONS), F.lit(False)), "action_not_in_bounded_set").when(F.col("known").isNull(), "unknown_analysis")
    return rows.select("id", "kind", F.when(reason.isNull(), "queued").otherwise("rejected").alias("state"), reason.alias("reason"), "created_at")


def claim_oldest(requests: DataFrame, now: int, holder: str, lease_ms: int) -> DataFrame:
    """The request to work on next, leased: the oldest that waits, or whose lease has run out."""
    free = (F.col("state") == "queued") | ((F.col("state") == "leased") & (F.col("lease_expires_at") < now))
    head = requests.where(free).orderBy("created_at", "id").limit(1)
    return head.select("id", F.lit("leased").alias("state"), F.lit(holder).alias("lease_holder"), F.lit(now + max(lease_ms, 1000)).cast("long").alias("lease_expires_at"))


TRANSITIONS = {("proposed", "verify"): "verified", ("proposed", "reject"): "rejected", ("verified", "apply"): "applied", ("verified", "reject"): "rejected", ("applied", "revert"): "reverted"}


def lifecycle(events: DataFrame) -> DataFrame:
    """(id, state, refused): a fold of each proposal's events (id, at, action) in order; actions that the state does not allow are counted."""
    known = [F.struct(F.lit(s).alias("s"), F.lit(a).alias("a"), F.lit(t).alias("t")) for (s, a), t in TRANSITIONS.items()]
    rows = events.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "action"))).alias("e"))
    to = lambda acc, e: F.filter(F.array(*known), lambda k: (k.s == acc.state) & (k.a == e.action))
    fold = F.aggregate(
        "e",
        F.struct(F.lit("proposed").alias("state"), F.lit(0).cast("long").alias("refused")),
        lambda acc, e: F.when(F.size(to(acc, e)) > 0, F.struct(F.get(to(acc, e), F.lit(0)).t.alias("state"), acc.refused.alias("refused"))).otherwise(
            F.struct(acc.state.alias("state"), (acc.refused + 1).alias("refused"))
        ),
    )
    return rows.select("id", fold.state.alias("state"), fold.refused.alias("refused"))


def annotations(rows: DataFrame, kinds: tuple[str, ...], longest: int) -> DataFrame:
    """Valid notes (entity, kind, text), each content once under its digest; the earliest of equals stays."""
    ok = F.col("kind").isin(*kinds) & (F.length("text") >= 1) & (F.length("text") <= longest)
    keyed = rows.where(ok).withColumn("id", F.sha2(F.concat_ws("\u0000", "entity", "kind", "text"), 256))
    return keyed.groupBy("id").agg(F.min("created_at").alias("created_at"), F.first("entity").alias("entity"), F.first("kind").alias("kind"))


def revisions(rows: DataFrame) -> DataFrame:
    """(id, accepted): a revision's parent, if it names one, must be there already in the same project."""
    p = rows.select(F.col("id").alias("parent"), F.col("project").alias("parent_project"), F.col("created_at").alias("parent_at"))
    joined = rows.join(p, "parent", "left")
    ok = F.col("parent").isNull() | ((F.col("parent_project") == F.col("project")) & (F.col("parent_at") <= F.col("created_at")))
    return joined.select("id", F.coalesce(ok, F.lit(False)).alias("accepted"))


def threads(messages: DataFrame) -> DataFrame:
    """(thread, n, state, last) of append-only message threads in time order."""
    w = Window.partitionBy("thread").orderBy("at", "id")
    rows = messages.withColumn("place", F.row_number().over(w))
    state = F.when(F.bool_or(F.col("kind") == "export"), "exported").when(F.bool_or(F.col("kind") == "proposal"), "proposal_linked").when(F.max("place") > 1, "discussing").otherwise("draft")
    return rows.groupBy("thread").agg(F.max("place").cast("long").alias("n"), state.alias("state"), F.max_by("id", "place").alias("last"))


def insert_or_ignore(held: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``held`` and those rows of ``new`` whose keys it has not. With the sides exchanged, new rows replace held ones."""
    return held.unionByName(new.join(held.select(*keys), keys, "left_anti"))
