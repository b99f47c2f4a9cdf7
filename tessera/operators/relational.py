"""Reports and maintenance jobs over log, job and document tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.tables import saved


def log_kpis(log: DataFrame) -> DataFrame:
    """log (refused boolean, time_ms, rating) to one row; zeros for an empty log."""
    n, refused = F.count("*"), F.count_if("refused")
    return log.agg(
        n.alias("total"),
        refused.alias("refusals"),
        F.round(F.when(n == 0, 0.0).otherwise(refused / n), 6).alias("refusal_ratio"),
        F.round(F.coalesce(F.avg(F.coalesce(F.col("time_ms").cast("double"), F.lit(0.0))), F.lit(0.0)), 4).alias("mean_time_ms"),
        F.count_if(F.col("rating") == "up").alias("up"),
        F.count_if(F.col("rating") == "down").alias("down"),
    )


def top_questions(log: DataFrame, k: int = 5) -> DataFrame:
    """The k most frequent trimmed questions; among equals the one asked first."""
    q = log.select(F.trim("question").alias("question"), "id").where("question <> ''")
    return q.groupBy("question").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).orderBy(F.desc("n"), "first_id").limit(k)


def page_of(rows: DataFrame, newest: str, key: str, offset: int, limit: int) -> DataFrame:
    """One page, newest first, with the total of the same filter on each row."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(F.desc(newest), F.desc(key)).offset(offset).limit(limit).join(F.broadcast(total))


def owned_rows(rows: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among the caller's; no owners table means all rows."""
    return rows if owners is None else rows.join(owners, key, "left_semi")


def distribution(assigned: DataFrame, label: str, k: int) -> DataFrame:
    """Count and share of each of the labels 0..k-1, absent ones included."""
    counts = assigned.groupBy(label).agg(F.count("*").alias("n"))
    every = assigned.sparkSession.range(k).select(F.col("id").cast("int").alias(label))
    total = F.sum("n").over(Window.partitionBy())
    return every.join(counts, label, "left").fillna(0, ["n"]).select(label, "n", F.round(F.when(total == 0, 0.0).otherwise(F.col("n") / total), 6).alias("share"))


def coverage(docs: DataFrame, version: Column, current: Column, label: Column) -> DataFrame:
    """How many documents are unclear (version set, no label), stale (older version) or untouched."""
    return docs.agg(F.count_if(version.isNotNull() & label.isNull()).alias("unclear"), F.count_if(version.isNotNull() & (version < current)).alias("stale"), F.count_if(version.isNull()).alias("untouched"), F.count("*").alias("total"))


def subject_purity(rows: DataFrame, subject: str, folder: str, top: int = 3) -> DataFrame:
    """Per subject: its largest folder, that folder's count, the number of folders, and the top folders in order."""
    n = rows.groupBy(subject, folder).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(subject).orderBy(F.desc("n"), folder))
    best = n.withColumn("r", rank)
    names = F.array_sort(F.collect_list(F.when(F.col("r") <= top, F.struct("r", F.col(folder).alias("f")))))
    out = best.groupBy(subject).agg(F.max(F.when(F.col("r") == 1, F.col(folder))).alias("top_folder"), F.max("n").alias("top_n"), F.count("*").alias("folders"), F.sum("n").alias("n"), names.alias("t"))
    return out.select(subject, "top_folder", "top_n", "folders", "n", F.array_join(F.transform("t", lambda x: x["f"].cast("string")), ",").alias("top3"))


def missing_ids(asked: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """Asked ids with no row."""
    return asked.select(key).dropDuplicates().join(have.select(key), key, "left_anti")


def orphan_vectors(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """vectors (id string) that are no number or have no chunk (id long)."""
    n = vectors.withColumn("_n", F.expr("try_cast(id AS bigint)"))
    return n.join(chunks.select(F.col("id").alias("_n")).distinct(), "_n", "left_anti").select("id", F.col("_n").isNull().alias("not_numeric"))


def stale_vectors(vectors: DataFrame, prefix: str, active: str) -> DataFrame:
    """Vectors of earlier models (own prefix, not the active one) whose id the active collection also holds."""
    own = vectors.where(F.col("collection").startswith(prefix))
    return own.where(F.col("collection") != active).join(own.where(F.col("collection") == active).select("id"), "id", "left_semi")


def cascade_plan(notebooks: DataFrame, tables: dict[str, DataFrame], running: DataFrame) -> DataFrame:
    """notebooks (notebook_id) to erase and tables (id, notebook_id) to (table, id, blocked)."""
    busy = running.select("notebook_id").distinct().withColumn("blocked", F.lit(True))
    out = None
    for name, rows in tables.items():
        part = rows.join(notebooks, "notebook_id", "left_semi").select(F.lit(name).alias("table"), "id", "notebook_id")
        out = part if out is None else out.unionByName(part)
    return out.join(busy, "notebook_id", "left").select("table", "id", F.coalesce("blocked", F.lit(False)).alias("blocked"))


def backfill_owner(rows: DataFrame, owners: DataFrame, admins: DataFrame, key: str) -> DataFrame:
    """A null owner becomes that of its key, else the oldest admin."""
    oldest = admins.agg(F.min_by("user_id", F.struct("created_at", "user_id")).alias("_admin"))
    return rows.join(owners.select(key, F.col("owner_id").alias("_own")), key, "left").join(F.broadcast(oldest)).withColumn("owner_id", F.coalesce("owner_id", "_own", "_admin")).drop("_own", "_admin")


def backfill_index(rows: DataFrame, group: str, key: str, index: str) -> DataFrame:
    """A null index becomes the place of the row in its group, from 0."""
    return rows.withColumn(index, F.coalesce(index, F.row_number().over(Window.partitionBy(group).orderBy(key)) - 1))


def conflicting(rows: DataFrame, key: str, active: Column) -> DataFrame:
    """Keys with more than one active row."""
    return rows.where(active).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def queue_position(jobs: DataFrame, queued: Column, partition: list[str], order: list[str]) -> DataFrame:
    """Place of each queued row among the queued, from 1; others are left out. One queue per partition."""
    return jobs.where(queued).withColumn("position", F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))


def expired_leases(jobs: DataFrame, now: Column, lease_s: int = 60, limits: dict[str, int] | None = None, limit: int = 3) -> DataFrame:
    """running jobs whose lease is too old or absent: failed once out of attempts, else queued again."""
    most = F.lit(limit)
    for kind, n in (limits or {}).items():
        most = F.when(F.col("job_type") == kind, n).otherwise(most)
    old = F.col("lease_at").isNull() | (F.col("lease_at") < now - F.make_dt_interval(secs=F.lit(lease_s)))
    return jobs.where((F.col("status") == "running") & old).withColumn("new_status", F.when(F.col("attempts") >= most, "failed").otherwise("queued"))


def stuck_documents(docs: DataFrame, jobs: DataFrame) -> DataFrame:
    """docs (doc_id, status, error_text) and jobs (doc_id, status): what an interrupted run left and its new status."""
    queued = jobs.where("status = 'queued'").select("doc_id").distinct().withColumn("_q", F.lit(True))
    live = jobs.where("status IN ('queued', 'running')").select("doc_id").distinct().withColumn("_l", F.lit(True))
    rows = docs.where("status IN ('indexing', 'pending')").join(queued, "doc_id", "left").join(live, "doc_id", "left")
    new = F.when((F.col("status") == "indexing") & F.col("_q"), "pending").when(F.col("_l").isNull(), "error")
    return rows.withColumn("new_status", new).where("new_status IS NOT NULL").withColumn("error_text", F.when(F.col("new_status") == "error", F.coalesce("error_text", F.lit("interrupted"))).otherwise(F.col("error_text"))).drop("_q", "_l")


def order_statistics(rows: DataFrame, by: str, value: str, wanted: DataFrame, few: int = 10_000, buckets: int = 1024) -> DataFrame:
    """(by, name, x): the k-th smallest value of each group, for wanted (by, name, k from 1). Exact, for groups of any size: histogram passes narrow each
    wanted one to a range of at most `few` rows, or of equal values, and only those rows are ordered. Null values do not count."""
    rows = saved(rows.where(F.col(value).isNotNull()).select(by, F.col(value).cast("double").alias("_v")), "values")
    whole = rows.groupBy(by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_n"))
    state = saved(wanted.select(by, "name", F.col("k").cast("long").alias("k")).join(whole, by), "ranges")
    open_ = (F.col("_n") > few) & (F.col("_lo") < F.col("_hi"))
    while state.where(open_).limit(1).count():
        some = state.where(open_).select(by, "name", "k", "_lo", "_hi")
        inside = rows.join(some, by).where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
        bucket = F.least(F.lit(buckets - 1), F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * buckets).cast("int"))
        counts = inside.groupBy(by, "name", "k", bucket.alias("_b")).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_n"))
        before = F.sum("_n").over(Window.partitionBy(by, "name").orderBy("_b")) - F.col("_n")  # at most `buckets` rows
        narrowed = counts.withColumn("_before", before).where((F.col("_before") < F.col("k")) & (F.col("k") <= F.col("_before") + F.col("_n")))
        state = saved(state.where(~open_).unionByName(narrowed.select(by, "name", (F.col("k") - F.col("_before")).alias("k"), "_lo", "_hi", "_n")), "ranges")
    settled = state.where("_lo = _hi").select(by, "name", F.col("_lo").alias("x"))
    left = rows.join(state.where("_lo < _hi"), by).where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
    place = F.row_number().over(Window.partitionBy(by, "name").orderBy("_v"))  # at most `few` rows
    return settled.unionByName(left.withColumn("_r", place).where("_r = k").select(by, "name", F.col("_v").alias("x")))


def timing_summary(calls: DataFrame, group: str, value: str) -> DataFrame:
    """Nearest-rank p50 and p90, largest, total and count by group, from exact order statistics."""
    known = calls.where(F.col(value).isNotNull())
    totals = known.groupBy(group).agg(F.max(value).alias("longest"), F.round(F.sum(value), 2).alias("total"), F.count("*").alias("n"))
    share = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.ceil(F.col("n") * p).alias("k")) for name, p in (("p50", 0.5), ("p90", 0.9))])).alias("w")
    found = order_statistics(known, group, value, totals.select(group, share).select(group, "w.*"))
    at = lambda name: F.max(F.when(F.col("name") == name, F.col("x"))).alias(name)
    return found.groupBy(group).agg(at("p50"), at("p90")).join(totals, group).select(group, "p50", "p90", "longest", "total", "n")
