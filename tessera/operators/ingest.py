"""Ingest: deduplication, versions, upserts, cursors. Tables are snapshots; a merge gives the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_of(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("__r = 1").drop("__r")


def new_stubs(stubs: DataFrame, held: DataFrame, aliases: DataFrame) -> DataFrame:
    """Stubs that aren't held by id, landing URL or alias; one for each id."""
    rest = stubs.join(held.select("stable_id"), "stable_id", "left_anti")
    rest = rest.join(held.filter(F.col("landing_url").isNotNull()).select("landing_url").distinct(), "landing_url", "left_anti")
    return first_of(rest.join(aliases.select(F.col("alias").alias("stable_id")).distinct(), "stable_id", "left_anti"), ["stable_id"], ["landing_url"])


def by_content(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """(payload_hash, first_id, copies) of equal texts."""
    return docs.groupBy(F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("payload_hash")).agg(F.min(ident).alias("first_id"), F.count("*").alias("copies"))


def upsert_versions(current: DataFrame, incoming: DataFrame, key: str = "stable_id") -> DataFrame:
    """The next snapshot: an incoming row replaces the held one, its version rises only if the payload hash differs, search_excluded stays set once set, and nothing is deleted."""
    old = current.select(F.col(key), *(F.col(c).alias(f"__{c}") for c in ("payload_hash", "version", "search_excluded")))
    changed = incoming.join(old, key, "left").withColumn("version", F.when(F.col("__version").isNull(), 1).when(F.col("__payload_hash").eqNullSafe(F.col("payload_hash")), F.col("__version")).otherwise(F.col("__version") + 1)).withColumn("search_excluded", F.coalesce("__search_excluded", F.lit(False)) | F.coalesce("search_excluded", F.lit(False)))
    return current.join(incoming.select(key), key, "left_anti").unionByName(changed.select(*current.columns))


def archived(current: DataFrame, incoming: DataFrame, key: str = "stable_id") -> DataFrame:
    """Held rows that an incoming row with another payload replaces."""
    new = incoming.select(F.col(key), F.col("payload_hash").alias("__new"))
    return current.join(new, key).filter(~F.col("payload_hash").eqNullSafe(F.col("__new"))).drop("__new")


def merge_manual_wins(current: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    rank = F.when(F.col("added_by") == "manual", 0).otherwise(1)
    return first_of(current.unionByName(incoming), key, [rank, F.col("added_by")])


def merge_first_writer(current: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    return current.unionByName(incoming.join(current.select(*key), key, "left_anti").dropDuplicates(key))


def rekey(table: DataFrame, mapping: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Ids replaced by the survivors they are mapped to, in every id column."""
    for c in columns:
        m = mapping.select(F.col("old_id").alias("__old"), F.col("new_id").alias("__new"))
        table = table.join(m, F.col(c) == F.col("__old"), "left").withColumn(c, F.coalesce("__new", c)).drop("__old", "__new")
    return table


def since(stubs: DataFrame, watermark: str | None, overlap_days: int = 2, at: str = "date") -> DataFrame:
    """Stubs from the watermark on, rolled back for late arrivals."""
    return stubs if watermark is None else stubs.filter(F.col(at) >= F.date_sub(F.to_date(F.lit(watermark)), overlap_days))


def next_watermark(run: DataFrame, today: str, at: str = "date") -> DataFrame:
    """One row, watermark: the latest date before the first failure, never beyond today; null if the first stub failed."""
    failed = run.filter(~F.col("ok")).agg(F.min(at).alias("first_failure"))
    return run.join(F.broadcast(failed)).filter(F.col("ok") & (F.col("first_failure").isNull() | (F.col(at) < F.col("first_failure")))).agg(F.least(F.max(at), F.to_date(F.lit(today))).alias("watermark"))  # failed is one row


def due_checks(queue: DataFrame, today: str) -> DataFrame:
    """Queue rows with something outstanding whose backoff has run out."""
    from ..functions.legal import backoff_days

    return queue.filter((F.col("outstanding") > 0) & (F.date_add("checked_on", backoff_days(F.col("checks")).cast("int")) <= F.to_date(F.lit(today))))


def drained(runs: DataFrame, last: int = 3) -> DataFrame:
    """Sources of which the last runs stored nothing."""
    w = Window.partitionBy("source_key").orderBy(F.desc("run_id"))
    recent = runs.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= last)
    return recent.groupBy("source_key").agg(F.count("*").alias("runs"), F.sum("stored").alias("stored")).filter((F.col("runs") == last) & (F.col("stored") == 0)).select("source_key")


def job_states(events: DataFrame) -> DataFrame:
    """The last state of each job of a log (job_id, at, state)."""
    return events.groupBy("job_id").agg(F.max_by("state", F.struct("at", "state")).alias("state"), F.max("at").alias("at"))


def ladder(stubs: DataFrame, held: DataFrame, aliases: DataFrame) -> DataFrame:
    """stubs with decision: held (by id, landing URL or alias, unchanged), refetch (held, but its hash differs or it says it was revised), repeat (a later stub of the same id) or new."""
    by_id = held.select("stable_id", F.col("stable_id").alias("__i"), F.col("contenthash").alias("__hi"))
    by_url = held.filter(F.col("landing_url").isNotNull()).groupBy("landing_url").agg(F.min("stable_id").alias("__u"), F.min_by("contenthash", "stable_id").alias("__hu"))
    by_name = aliases.select(F.col("alias").alias("stable_id"), F.col("canonical_id").alias("__a")).join(held.select(F.col("stable_id").alias("__a"), F.col("contenthash").alias("__ha")), "__a").groupBy("stable_id").agg(F.min("__a").alias("__a"), F.min_by("__ha", "__a").alias("__ha"))
    rows = stubs.join(by_id, "stable_id", "left").join(by_url, "landing_url", "left").join(by_name, "stable_id", "left")
    rows = rows.withColumn("held_id", F.coalesce("__i", "__u", "__a")).withColumn("__h", F.when(F.col("__i").isNotNull(), F.col("__hi")).when(F.col("__u").isNotNull(), F.col("__hu")).otherwise(F.col("__ha")))
    changed = F.coalesce(F.col("revision"), F.lit(False)) | F.coalesce(F.col("contenthash") != F.col("__h"), F.lit(False))
    first = F.row_number().over(Window.partitionBy("stable_id").orderBy("position")) == 1
    return rows.withColumn("decision", F.when(~first, "repeat").when(F.col("held_id").isNull(), "new").when(changed, "refetch").otherwise("held")).select(*stubs.columns, "held_id", "decision")


def with_tombstones(docs: DataFrame, fetches: DataFrame) -> DataFrame:
    """docs with upstream_status gone_404 where the last fetch said that it's gone; no row goes."""
    last = fetches.groupBy("stable_id").agg(F.max_by("status", "at").alias("__s"))
    return docs.join(last, "stable_id", "left").withColumn("upstream_status", F.when(F.col("__s").isin(404, 410), "gone_404").otherwise(F.col("upstream_status"))).drop("__s")


def worth_asking(keys: DataFrame, misses: DataFrame, now: str, days: int) -> DataFrame:
    """Keys that weren't asked for in vain within so many days."""
    recent = misses.filter(F.col("at") > F.to_date(F.lit(now)) - days)
    return keys.join(recent.select("key"), "key", "left_anti")


def backfill_frontier(runs: DataFrame) -> DataFrame:
    """(source_key, frontier): where a full walk goes on: the last page of the latest run, if that was clean and not cut short; else of the latest before that was."""
    return runs.filter((F.col("errors") == 0) & ~F.col("capped") & ~F.col("rate_limited")).groupBy("source_key").agg(F.max_by("page", F.when(F.col("page").isNotNull(), F.col("run_id"))).alias("frontier"))
