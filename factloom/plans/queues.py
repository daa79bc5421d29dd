"""J and N: lease queue and notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions.times import epoch_us

from factloom.operators import queue
from factloom.plans.registry import query
from factloom.plans.sql import using
from factloom.sources import projections
from factloom.sources.tables import table

Q = using("queue")
#: The queue's clock: the middle of the events' time.
NOW = "(SELECT (min(created_at)+max(created_at))//2 FROM q)"


def jobs(spark, d):
    return projections.queue(spark, d)


def now(rows) -> int:
    a, b = rows.agg(F.min("created_at"), F.max("created_at")).first()
    return (a + b) // 2


@query("j1_job_identity", Q + " SELECT event_id, id FROM q")
def j1(spark, d):
    return jobs(spark, d).select("event_id", "id")


def requests(rows):
    return rows.where("event_id % 3 = 0").select("id", (F.col("priority") + 5).alias("priority"), (F.col("created_at") + 1).alias("created_at"))


@query(
    "j2_submit",
    Q + f", r AS (SELECT id FROM q WHERE event_id%3=0 UNION SELECT sha256('new:'||event_id) FROM q WHERE event_id%100=0) SELECT r.id, CASE WHEN q.state IS NULL OR q.state IN ('queued','failed','cancelled') THEN 'acquired' WHEN q.state='completed' THEN 'settled' WHEN q.state='running' AND q.lease_expires_at<{NOW} THEN 'acquired' ELSE 'held' END AS outcome FROM r LEFT JOIN q USING (id)",
)
def j2(spark, d):
    q = jobs(spark, d)
    new = q.where("event_id % 100 = 0").select(F.sha2(F.concat(F.lit("new:"), F.col("event_id").cast("string")), 256).alias("id"))
    return queue.submitted(q, requests(q).select("id").unionByName(new), now(q))


@query("j3_enqueue", Q + " SELECT id, CASE WHEN event_id%3=0 AND state='failed' THEN 'queued' ELSE state END AS state, CASE WHEN event_id%3=0 AND state IN ('queued','failed') THEN priority+5 ELSE priority END AS priority FROM q UNION ALL SELECT sha256('new:'||event_id), 'queued', priority FROM q WHERE event_id%100=0")
def j3(spark, d):
    """Every third job is asked for again, and a hundredth as many are new."""
    q = jobs(spark, d)
    new = q.where("event_id % 100 = 0").select(F.sha2(F.concat(F.lit("new:"), F.col("event_id").cast("string")), 256).alias("id"), "priority", "created_at")
    return queue.enqueued(q, requests(q).unionByName(new)).select("id", "state", "priority")


@query("j4_claim_next", Q + f" SELECT id, 'running' AS state, 'w1' AS lease_holder, CAST({NOW}+60000 AS BIGINT) AS lease_expires_at, CAST({NOW} AS BIGINT) AS heartbeat_at FROM q WHERE state='queued' ORDER BY priority DESC, created_at, id LIMIT 1")
def j4(spark, d):
    q = jobs(spark, d)
    return queue.claim_next(q, now(q), "w1", 60_000).select("id", "state", "lease_holder", "lease_expires_at", "heartbeat_at")


@query("j4_queue_order", Q + " SELECT id, row_number() OVER (PARTITION BY owner ORDER BY priority DESC, created_at, id) AS place FROM q WHERE state='queued'")
def j4_order(spark, d):
    from factloom.operators.search import latest

    return latest(jobs(spark, d).where("state = 'queued'"), ["owner"], queue.by_urgency()).select("id", "place")


@query("j5_claim_by_id", Q + f" SELECT id, 'w2' AS lease_holder, CAST({NOW} AS BIGINT) AS heartbeat_at FROM q WHERE event_id%50=7 AND state='queued'")
def j5(spark, d):
    q = jobs(spark, d)
    return queue.claimed(q.where("event_id % 50 = 7 AND state = 'queued'"), now(q), "w2", 60_000).select("id", "lease_holder", "heartbeat_at")


@query("j6_cancel", Q + " SELECT id, state='queued' AS applied FROM q WHERE event_id%5=0")
def j6(spark, d):
    q = jobs(spark, d)
    return queue.cancelled(q, q.where("event_id % 5 = 0").select("id"))


@query(
    "j7_finish",
    Q + f", r AS (SELECT id, 'worker-'||(event_id%3) AS holder, CASE WHEN event_id%2=0 THEN 'completed' ELSE 'failed' END AS outcome, CASE WHEN event_id%4=0 THEN 'result' END AS result FROM q) SELECT id, CASE WHEN state<>'running' OR lease_holder<>holder THEN 'not_lease_holder' WHEN lease_expires_at<{NOW} THEN 'lease_expired' WHEN outcome='completed' AND result IS NULL THEN 'result_required' ELSE outcome END AS verdict FROM r JOIN q USING (id)",
)
def j7(spark, d):
    q = jobs(spark, d)
    e = F.col("event_id")
    reports = q.select(
        "id",
        F.concat(F.lit("worker-"), (e % 3).cast("string")).alias("holder"),
        F.when(e % 2 == 0, "completed").otherwise("failed").alias("outcome"),
        F.when(e % 4 == 0, "result").alias("result"),
    )
    return queue.finished(q, reports, now(q))


@query("j7_heartbeat", Q + f", b AS (SELECT *, coalesce(state='running' AND lease_holder='worker-'||(event_id%3), false) AS ok FROM q) SELECT id, ok AS applied, CASE WHEN ok THEN CAST({NOW}+60000 AS BIGINT) ELSE lease_expires_at END AS lease_expires_at FROM b")
def j7_beat(spark, d):
    q = jobs(spark, d)
    beats = q.select("id", F.concat(F.lit("worker-"), (F.col("event_id") % 3).cast("string")).alias("holder"))
    return queue.beaten(q, beats, now(q), 60_000)


@query("j8_reap_jobs", Q + f" SELECT id, 'failed' AS state, 'lease_expired' AS reason FROM q WHERE state='running' AND lease_expires_at<{NOW}")
def j8(spark, d):
    q = jobs(spark, d)
    return queue.reaped(q, now(q), "failed")


@query("j10_reap_requests", Q + f" SELECT id, 'queued' AS state FROM q WHERE state='running' AND lease_expires_at<{NOW}")
def j10(spark, d):
    q = jobs(spark, d)
    return queue.reaped(q, now(q), "queued").select("id", "state")


REQUESTS = """WITH e AS (SELECT sha256(user_id||chr(0)||event_type||':'||(event_id%50)) AS id, event_id AS seq, epoch_us(ts)//1000 AS created_at, 'a'||(event_id%7) AS analysis,
 CASE event_type WHEN 'view' THEN 'inspect' WHEN 'click' THEN 'annotate' WHEN 'purchase' THEN 'propose_patch' ELSE event_type END AS kind FROM events),
 r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY created_at, seq) AS k FROM e) WHERE k=1),
 s AS (SELECT id, kind, CASE WHEN kind IN ('inspect','annotate','propose_patch') AND analysis<>'a3' THEN 'queued' ELSE 'rejected' END AS state,
 CASE WHEN kind NOT IN ('inspect','annotate','propose_patch') THEN 'action_not_in_bounded_set' WHEN analysis='a3' THEN 'unknown_analysis' END AS reason, created_at FROM r)"""


def agent_requests(spark, d):
    """A request per event: errors and other types are no actions, analysis a3 was never published."""
    e, k = F.col("event_type"), F.col("event_id")
    kind = F.when(e == "view", "inspect").when(e == "click", "annotate").when(e == "purchase", "propose_patch").otherwise(e)
    rows = table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("owner"),
        F.concat_ws(":", e, (k % 50).cast("string")).alias("request_key"),
        kind.alias("kind"),
        F.concat(F.lit("a"), (k % 7).cast("string")).alias("analysis"),
        F.floor(epoch_us(F.col("ts")) / 1000).alias("created_at"),
        k.alias("seq"),
    )
    return queue.asked(rows, spark.createDataFrame([(f"a{i}",) for i in (0, 1, 2, 4, 5, 6)], "analysis string"))


@query("j10_requests", REQUESTS + " SELECT id, kind, state, reason, created_at FROM s")
def j10_requests(spark, d):
    return agent_requests(spark, d)


@query("j10_claim_oldest", REQUESTS + " SELECT id, 'leased' AS state, 'agent-1' AS lease_holder, (SELECT max(created_at) FROM s)+1000 AS lease_expires_at FROM s WHERE CASE WHEN kind='annotate' THEN created_at+5000<(SELECT max(created_at) FROM s) ELSE kind='propose_patch' END AND state='queued' ORDER BY created_at, id LIMIT 1")
def j10_claim(spark, d):
    """Inspections are done, annotations leased for five seconds, patches wait."""
    rows = agent_requests(spark, d)
    taken = (F.col("state") == "queued") & (F.col("kind") == "annotate")
    state = F.when(taken, "leased").when((F.col("state") == "queued") & (F.col("kind") == "inspect"), "completed").otherwise(F.col("state"))
    held = rows.withColumns({"state": state, "lease_expires_at": F.when(taken, F.col("created_at") + 5000)})
    return queue.claim_oldest(held, rows.agg(F.max("created_at")).first()[0], "agent-1", 10)


@query(
    "n1_annotations",
    "WITH a AS (SELECT CAST(user_id AS VARCHAR) AS entity, event_type AS kind, props AS text, epoch_us(ts) AS created_at FROM events WHERE event_type IN ('view','click','error') AND length(props) BETWEEN 1 AND 9) SELECT sha256(entity||chr(0)||kind||chr(0)||text) AS id, min(created_at) AS created_at, entity, kind FROM a GROUP BY entity, kind, text",
)
def n1(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("entity"), F.col("event_type").alias("kind"), F.col("props").alias("text"), epoch_us(F.col("ts")).alias("created_at"))
    return queue.annotations(rows, ("view", "click", "error"), 9)


@query("n2_revisions", "WITH r AS (SELECT event_id AS id, user_id%5 AS project, epoch_us(ts) AS created_at, CASE WHEN event_id%4<>0 THEN event_id//2 END AS parent FROM events) SELECT r.id, r.parent IS NULL OR coalesce(p.project=r.project AND p.created_at<=r.created_at, false) AS accepted FROM r LEFT JOIN r p ON p.id=r.parent")
def n2(spark, d):
    rows = table(spark, d, "events").select(
        F.col("event_id").alias("id"), (F.col("user_id") % 5).alias("project"), epoch_us(F.col("ts")).alias("created_at"), F.when(F.col("event_id") % 4 != 0, F.floor(F.col("event_id") / 2)).alias("parent")
    )
    return queue.revisions(rows)


@query("n3_threads", "WITH m AS (SELECT user_id AS thread, event_id AS id, ts, CASE event_type WHEN 'purchase' THEN 'proposal' WHEN 'error' THEN 'export' ELSE 'message' END AS kind FROM events) SELECT thread, count(*) AS n, CASE WHEN bool_or(kind='export') THEN 'exported' WHEN bool_or(kind='proposal') THEN 'proposal_linked' WHEN count(*)>1 THEN 'discussing' ELSE 'draft' END AS state, arg_max(id, (ts, id)) AS last FROM m GROUP BY thread", also="n3_threads_whole")
def n3(spark, d):
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "purchase", "proposal").when(F.col("event_type") == "error", "export").otherwise("message")
    return queue.threads(e.select(F.col("user_id").alias("thread"), F.col("event_id").alias("id"), F.col("ts").alias("at"), kind.alias("kind")))


@query("a17_job_counters", Q + " SELECT owner, count(*) FILTER (state='completed') AS passed, count(*) FILTER (state='failed') AS failed, count(*) FILTER (state NOT IN ('completed','failed')) AS open FROM q GROUP BY owner")
def a17(spark, d):
    s = F.col("state")
    return jobs(spark, d).groupBy("owner").agg(
        F.count_if(s == "completed").alias("passed"), F.count_if(s == "failed").alias("failed"), F.count_if(~s.isin("completed", "failed")).alias("open")
    )
