"""The job log: states, queue order, leases, conflicts, cadence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds without a heartbeat, and without progress, after which a running job counts as stalled or wedged; how often one is resumed, how many run at once.
STALLED, WEDGED, MOST_RESUMES, MOST_RUNNING = 150, 1800, 8, 6


def fifo(jobs: DataFrame) -> DataFrame:
    """Queued jobs with their place, the oldest first."""
    w = Window.partitionBy("status").orderBy("started_at", "job_id")
    return jobs.filter(F.col("status") == "queued").withColumn("place", F.row_number().over(w))


def listing(jobs: DataFrame) -> DataFrame:
    """All jobs, running ones first, then the latest."""
    return jobs.orderBy((F.col("status") == "running").desc(), F.desc("started_at"), "job_id")


def health(jobs: DataFrame, now: Column) -> DataFrame:
    """Running jobs with health: orphan (no lease), stalled (an old heartbeat), wedged (a fresh one, but old progress) or well."""
    age = lambda c: F.unix_seconds(now) - F.unix_seconds(c)
    state = F.when(F.col("heartbeat_at").isNull(), "orphan").when(age("heartbeat_at") > STALLED, "stalled").when(age(F.coalesce("progress_at", "started_at")) > WEDGED, "wedged").otherwise("well")
    return jobs.filter(F.col("status") == "running").withColumn("health", state)


def resumable(jobs: DataFrame) -> DataFrame:
    """Interrupted jobs that haven't been resumed too often."""
    return jobs.filter((F.col("status") == "interrupted") & (F.col("resumes") < MOST_RESUMES))


def pruned(jobs: DataFrame, keep: int = 200) -> DataFrame:
    """Running jobs, and the newest `keep` of the others."""
    from .ranking import rank_all

    rest = rank_all(jobs.filter(F.col("status") != "running"), [F.desc("started_at"), F.asc("job_id")], "__place").filter(F.col("__place") <= keep).drop("__place")
    return jobs.filter(F.col("status") == "running").unionByName(rest)


def blocked(queued: DataFrame, running: DataFrame, *, scans: tuple[str, ...] = (), singletons: tuple[str, ...] = (), exclusive: tuple[str, ...] = (), deduped: tuple[str, ...] = ()) -> DataFrame:
    """queued jobs with blocked: a running job scans an overlapping set of sources (a missing source is all of them), is the same singleton, harvests the same source, or has the same kind and parameters."""
    scope = F.coalesce("source", F.lit("*"))
    r = running.select(F.col("kind").alias("r_kind"), scope.alias("r_scope"), F.col("params").alias("r_params")).distinct()
    q = queued.withColumn("__scope", scope)
    # few jobs run at a time (MOST_RUNNING, and those beside the queue): one row holds them
    q = q.join(F.broadcast(r.agg(F.collect_list(F.struct("r_kind", "r_scope", "r_params")).alias("__running"))))
    meets = lambda j: (F.col("__scope") == "*") | (j["r_scope"] == "*") | (F.col("__scope") == j["r_scope"])

    def conflict(j: Column) -> Column:
        both = lambda kinds: F.col("kind").isin(*kinds) & j["r_kind"].isin(*kinds) if kinds else F.lit(False)
        same = j["r_kind"] == F.col("kind")
        return (both(scans) & meets(j)) | (both(exclusive) & meets(j)) | (same & F.col("kind").isin(*singletons) if singletons else F.lit(False)) | (same & F.col("kind").isin(*deduped) & j["r_params"].eqNullSafe(F.col("params")) if deduped else F.lit(False))

    return q.withColumn("blocked", F.exists("__running", conflict)).drop("__running", "__scope")


def claimable(queued: DataFrame, running: DataFrame, exempt: tuple[str, ...] = (), most: int = MOST_RUNNING, **rules) -> DataFrame:
    """The queued jobs that may start now: those that nothing blocks, exempt kinds always, others in order while there are slots."""
    used = running.filter(~F.col("kind").isin(*exempt) if exempt else F.lit(True)).agg(F.count("*").alias("__used"))
    free = blocked(queued, running, **rules).filter(~F.col("blocked"))
    waits = ~F.col("kind").isin(*exempt) if exempt else F.lit(True)
    place = F.sum(waits.cast("int")).over(Window.partitionBy("status").orderBy("started_at", "job_id"))
    return free.withColumn("__place", place).join(F.broadcast(used)).filter(~waits | (F.col("__place") <= F.lit(most) - F.col("__used"))).drop("__place", "__used", "blocked")


def due(tasks: DataFrame, now: Column) -> DataFrame:
    """Enabled tasks that are due: minutes have passed since the last start (none: always), in the hour that is theirs, if they have one."""
    waited = F.col("last_started").isNull() | F.col("minutes").isNull() | (F.unix_seconds(now) - F.unix_seconds("last_started") >= 60 * F.col("minutes"))
    return tasks.filter(F.col("enabled") & waited & (F.col("hour").isNull() | (F.col("hour") == F.hour(now))))


def follow_ups(jobs: DataFrame, chain: DataFrame) -> DataFrame:
    """(job_id, follow_up): what a finished job that stored something starts, unless one of that kind started within its cool-down before; chain: (kind, follow_up, cool_down)."""
    done = jobs.filter((F.col("status") == "done") & (F.col("stored") > 0)).join(chain, "kind").select("follow_up", F.col("finished_at").alias("t"), F.lit(1).alias("ask"), "job_id", "cool_down", F.lit(None).cast("timestamp").alias("start"))
    starts = jobs.join(chain.select(F.col("follow_up").alias("kind")).distinct(), "kind", "left_semi").select(F.col("kind").alias("follow_up"), F.col("started_at").alias("t"), F.lit(0).alias("ask"), F.lit(None).cast("long").alias("job_id"), F.lit(None).cast("int").alias("cool_down"), F.col("started_at").alias("start"))
    w = Window.partitionBy("follow_up").orderBy("t", "ask").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = done.unionByName(starts).withColumn("last", F.last("start", ignorenulls=True).over(w)).filter("ask = 1")
    return rows.filter(F.col("last").isNull() | (F.unix_seconds("t") - F.unix_seconds("last") >= F.col("cool_down"))).select("job_id", "follow_up")


def claimed(claims: DataFrame) -> DataFrame:
    """(job_id, worker): of several claims of a job the first one wins."""
    return claims.groupBy("job_id").agg(F.min_by("worker", F.struct("at", "worker")).alias("worker"))
