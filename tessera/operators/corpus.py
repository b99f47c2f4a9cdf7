"""Corpus construction: ids, first-wins de-duplication, rubrics, splits, reports, and topic words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.tables import saved


def document_id(url: Column, text: Column) -> Column:
    """First 20 hex digits of the SHA-1 of the url, else of the first 2000 characters."""
    return F.substring(F.sha1(F.coalesce(F.nullif(F.trim(url), F.lit("")), F.substring(F.coalesce(text, F.lit("")), 1, 2000)).cast("binary")), 1, 20)


def prefix_key(text: Column, n: int = 400) -> Column:
    return F.substring(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " ")), 1, n)


def dedup_first_wins(rows: DataFrame, order: str, keys: list[str], save) -> DataFrame:
    """Walk in order; a row goes when a kept row has one of its keys. A dropped row claims nothing.

    Rounds: a row that is first for all its keys among the undecided is kept, and rows that share a key with it
    go. Keys are hot at most as groups of equal rows, which one minimum per key settles. save(df, name) cuts lineage."""
    open_, kept = save(rows.select(order, *keys), "undecided"), None
    while not open_.isEmpty():
        firsts = open_
        for k in keys:
            least = open_.where(F.col(k).isNotNull()).groupBy(k).agg(F.min(order).alias(f"_{k}"))
            firsts = firsts.join(least, k, "left")
        new = save(firsts.where(" AND ".join(f"({k} IS NULL OR _{k} = {order})" for k in keys)).select(order, *keys), "first")
        kept = new if kept is None else kept.unionByName(new)
        rest = open_.join(new.select(order), order, "left_anti")
        for k in keys:
            rest = rest.join(new.select(k).where(F.col(k).isNotNull()).distinct(), k, "left_anti")
        open_ = save(rest.select(order, *keys), "undecided")
    return rows if kept is None else rows.join(kept.select(order), order, "left_semi")


def map_rubric(rows: DataFrame, section: Column, table: DataFrame, ignored: DataFrame) -> DataFrame:
    """rubric by canonical section: the mapped name; "unlabelled" for ignored sections; null for unknown ones."""
    out = rows.withColumn("_s", section).join(table.toDF("_s", "rubric"), "_s", "left").join(ignored.toDF("_s").withColumn("_i", F.lit(True)), "_s", "left")
    return out.withColumn("rubric", F.coalesce("rubric", F.when(F.col("_i"), "unlabelled"))).drop("_s", "_i")


def demote_small(rows: DataFrame, rubric: str, least: int = 25) -> DataFrame:
    """Rubrics of fewer rows become unlabelled. Counts are summed before they are joined back."""
    small = rows.groupBy(rubric).agg(F.count("*").alias("_n")).where(F.col("_n") < least).select(rubric).withColumn("_d", F.lit(True))
    return rows.join(small, rubric, "left").withColumn(rubric, F.when(F.col("_d"), "unlabelled").otherwise(F.col(rubric))).drop("_d")


def stratified_split(rows: DataFrame, rubric: str, key: str, shares: tuple[float, float] = (0.7, 0.15), seed: str = "42") -> DataFrame:
    """Per rubric by hash order: rounded shares to train and validation, the rest to test; unlabelled rows to pool.

    Places come from counts below a hash prefix and a rank inside it, so a rubric with most rows is spread."""
    h = F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))
    marked = rows.withColumn("_h", h).withColumn("_b", F.substring("_h", 1, 2))
    per = marked.groupBy(rubric, "_b").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(rubric)
    per = per.select(rubric, "_b", (F.sum("_c").over(w.orderBy("_b")) - F.col("_c")).alias("_before"), F.sum("_c").over(w).alias("_n"))
    out = marked.join(per, [rubric, "_b"])
    place = F.col("_before") + F.row_number().over(Window.partitionBy(rubric, "_b").orderBy("_h", key))
    train, held = F.round(F.col("_n") * shares[0]), F.round(F.col("_n") * shares[1])
    split = F.when(F.col(rubric) == "unlabelled", "pool").when(F.col("_p") <= train, "train").when(F.col("_p") <= train + held, "validation").otherwise("test")
    return out.withColumn("_p", place).withColumn("split", split).drop("_h", "_b", "_before", "_n", "_p")


def split_leaks(rows: DataFrame, key: str) -> DataFrame:
    """Ids that occur in more than one split."""
    return rows.groupBy(key).agg(F.count_distinct("split").alias("splits")).where("splits > 1")


def counts_by(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value, n) over several columns in one pass."""
    flat = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("value")) for c in columns])).alias("x"))
    return flat.groupBy("x.field", "x.value").agg(F.count("*").alias("n"))


def quality_report(rows: DataFrame, text: str, group: list[str]) -> DataFrame:
    words = F.size(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(r"\S+"), 0))
    return rows.select(*group, text, words.alias("w")).groupBy(*group).agg(
        F.count("*").alias("records"),
        (F.count("*") - F.count_distinct(F.md5(prefix_key(F.col(text), 1 << 30)))).alias("exact_duplicates"),
        F.min("w").cast("long").alias("shortest"),
        F.percentile("w", 0.5).alias("median"),
        F.round(F.percentile("w", 0.95), 4).alias("p95"),
        F.max("w").cast("long").alias("longest"),
    )


def build_report(rows: DataFrame, order: str, text: str, fields: list[str], known: DataFrame, section: str, least: int = 200) -> DataFrame:
    """(field, value, n) of a corpus build: rows read, skipped as short (null text is empty) or as a repeat of an earlier
    prefix, what is kept by each of fields, and kept rows by sections that are not in known (one column)."""
    marked = rows.withColumn("_short", F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) < least).withColumn("_p", F.md5(prefix_key(F.col(text))))
    first = marked.where("NOT _short").groupBy("_p").agg(F.min(order).alias("_first"))
    marked = marked.join(first, "_p", "left").withColumn("_state", F.when(F.col("_short"), "short").when(F.col(order) != F.col("_first"), "duplicate").otherwise("kept"))
    marked = marked.join(known.toDF(section).distinct().withColumn("_known", F.lit(True)), section, "left")
    kept = F.col("_state") == "kept"
    said = lambda name, value: F.struct(F.lit(name).alias("field"), F.coalesce(value.cast("string"), F.lit("")).alias("value"))
    entries = [said("outcome", F.col("_state")), *[F.when(kept, said(f, F.col(f))) for f in fields], F.when(kept & F.col("_known").isNull(), said("unknown section", F.col(section)))]
    flat = marked.select(F.explode(F.array_compact(F.array(*entries))).alias("x"))
    return flat.groupBy("x.field", "x.value").agg(F.count("*").alias("n"))


def localized_names(docs: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs with the one name of (topic, language), else their own; and the pairs with more than one name."""
    one = names.groupBy("topic", "language").agg(F.min("name").alias("_name"), F.count_distinct("name").alias("names"))
    out = docs.join(one.where("names = 1"), ["topic", "language"], "left").withColumn("name", F.coalesce("_name", "name")).drop("_name", "names")
    return out, one.where("names > 1").select("topic", "language", "names")


def c_tf_idf(rows: DataFrame, top: int, share_groups: float = 0.7, share_docs: float = 0.15) -> DataFrame:
    """rows (grp, doc, term), repeats kept, to (grp, term, n, weight, rank).

    tf = n / words of the group; idf = ln(1 + mean group size / n over all groups). Terms used once, in most groups, or in too
    few of the group's documents are left out."""
    per_doc = rows.groupBy("grp", "doc", "term").agg(F.count("*").alias("c"))
    n = saved(per_doc.groupBy("grp", "term").agg(F.sum("c").alias("n"), F.count("*").alias("docs")), "group-terms")  # read four times
    size = n.groupBy("grp").agg(F.sum("n").alias("size"))
    docs = per_doc.select("grp", "doc").distinct().groupBy("grp").agg(F.count("*").alias("of"))
    every = n.groupBy("term").agg(F.sum("n").alias("total"), F.count("*").alias("groups"))
    mean = size.agg(F.avg("size").alias("mean"), F.count("*").alias("all_groups"))
    out = n.where("n >= 2").join(size, "grp").join(docs, "grp").join(every, "term").join(F.broadcast(mean))  # mean is one row
    floor = F.when(F.col("of") >= 5, F.greatest(F.lit(2.0), share_docs * F.col("of"))).otherwise(0.0)
    out = out.where((F.col("groups") <= share_groups * F.col("all_groups")) & (F.col("docs") >= floor))
    weight = F.round(F.col("n") / F.col("size") * F.log(1 + F.col("mean") / F.col("total")), 9)
    rank = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("weight"), "term"))
    return out.withColumn("weight", weight).withColumn("rank", rank).where(F.col("rank") <= top).select("grp", "term", "n", "weight", "rank")


def only_dominant(rows: DataFrame, share: float = 0.6) -> DataFrame:
    """rows (family, grp, term, n): terms with most of their uses inside one member of the family."""
    return rows.withColumn("_t", F.sum("n").over(Window.partitionBy("family", "term"))).where(F.col("n") >= share * F.col("_t")).drop("_t")
