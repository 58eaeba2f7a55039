"""Rankings, top-k, review candidates and budgeted prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import SEVERITY, category_phrase, class_tier, classify_path, est_tokens, is_edit

SOLO = ["failure_loop", "blind_write_attempt", "flip", "user_corrected", "secrets_file_touched"]


def category() -> Column:
    k = F.col("kind")
    return F.when(k.isin("churn", "rework", "re_read"), k).when(k == "failure_loop", "failure_loops").when(k == "blind_write_attempt", "fumbles").when(k == "action_loop", "action_loops")


def magnitude() -> Column:
    return F.when(F.col("kind").isin("churn", "failure_loop", "re_read"), F.size("idxs")).otherwise(1).cast("bigint")


def severity_pos(cat: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITY)), cat)


def edit_counts(actions: DataFrame) -> DataFrame:
    return actions.where(is_edit(F.col("kind")) & F.col("file_path").isNotNull()).groupBy("unit_id", F.col("file_path").alias("file")).agg(F.count("*").alias("edits"))


def breakdown(findings: DataFrame) -> DataFrame:
    """(unit_id, file, category, n) of ranking findings."""
    rows = findings.where("file is not null").withColumn("category", category()).where("category is not null")
    return rows.groupBy("unit_id", "file", "category").agg(F.sum(magnitude()).alias("n"))


def rank_files(findings: DataFrame, actions: DataFrame) -> DataFrame:
    """Files with a ranking finding: those edited first, by class, by edits, by path."""
    per = breakdown(findings).groupBy("unit_id", "file").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "n")))).alias("breakdown"))
    rows = per.join(edit_counts(actions), ["unit_id", "file"], "left").withColumn("edits", F.coalesce("edits", F.lit(0)).cast("bigint"))
    rows = rows.withColumn("class", classify_path(F.col("file")))
    w = Window.partitionBy("unit_id").orderBy(F.col("edits") == 0, class_tier(F.col("class")), F.desc("edits"), "file")
    return rows.withColumn("rank", F.row_number().over(w))


def top_struggles(ranked: DataFrame, n: int = 3) -> DataFrame:
    return ranked.withColumn("total", F.count("*").over(Window.partitionBy("unit_id"))).where(F.col("rank") <= n)


def needs_review(findings: DataFrame, ranked: DataFrame, cap: int = 3) -> DataFrame:
    """Files with two findings or one of a kind that is enough alone; ranked first, then by path."""
    own = findings.where("file is not null and kind <> 'opening_move'")
    per = own.groupBy("unit_id", "file").agg(F.count("*").alias("n_findings"), F.bool_or(F.col("kind").isin(SOLO)).alias("solo"), *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("secrets_file_touched", "flip", "user_corrected", "true_revert", "large_write_instant_accept")])
    rows = per.where("n_findings >= 2 or solo").join(ranked.select("unit_id", "file", "rank", "breakdown"), ["unit_id", "file"], "left")
    w = Window.partitionBy("unit_id").orderBy(F.col("rank").asc_nulls_last(), "file")
    return rows.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= cap)


def reason_sentence() -> Column:
    """A candidate's phrases: ranked categories by severity, then the other kinds."""

    def times(n: str, one: str) -> Column:
        return F.when(F.col(n) > 1, F.concat(F.lit(one + " "), F.col(n).cast("string"), F.lit("x"))).when(F.col(n) == 1, one)

    parts = [F.when(F.col("breakdown").isNotNull() & F.map_contains_key("breakdown", F.lit(c)), category_phrase(F.lit(c), F.element_at("breakdown", F.lit(c)))) for c in SEVERITY]
    parts.append(F.when(F.col("n_secrets_file_touched") > 0, "secrets file touched"))
    parts.append(times("n_flip", "flipped after pushback"))
    parts.append(times("n_user_corrected", "user-corrected"))
    parts.append(F.when(F.col("n_true_revert") > 0, F.concat(F.lit("self-reverted "), F.col("n_true_revert").cast("string"), F.lit("x"))))
    large = F.col("n_large_write_instant_accept")
    parts.append(F.when(large > 0, F.concat(large.cast("string"), F.lit(" large write"), F.when(large > 1, "s").otherwise(""), F.lit(" accepted instantly"))))
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull()), ", ")


def representative_findings(findings: DataFrame, k: int = 4) -> DataFrame:
    """Up to ``k`` findings a file, one of each category by severity before any second."""
    rows = findings.where("file is not null").withColumn("category", category()).where("category is not null")
    first = F.element_at("idxs", 1)
    inside = Window.partitionBy("unit_id", "file", "category").orderBy("detector_ord", first, F.element_at("idxs", -1))
    rows = rows.withColumn("round", F.row_number().over(inside)).withColumn("severity", severity_pos(F.col("category")))
    across = Window.partitionBy("unit_id", "file").orderBy("round", "severity")
    return rows.withColumn("slot", F.row_number().over(across)).where(F.col("slot") <= k)


def budgeted_prefix(items: DataFrame, by: list[str], order: list[Column], cost: Column, envelope: int, cap_bytes: int) -> DataFrame:
    """The longest prefix of each group whose bytes and the envelope's stay within the cap; totals go on all rows."""
    w = Window.partitionBy(*by).orderBy(*order)
    rows = items.withColumn("used", F.lit(envelope) + F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("total", F.count("*").over(Window.partitionBy(*by))).where(F.col("used") <= cap_bytes)


def greedy_skip(items: DataFrame, by: str, order: str, cost: str, cap: int) -> DataFrame:
    """Walk each group's items in order, keep each that still fits and skip the rest; an ordered fold a group.

    A group is one row's array; groups are conversations, whose size their log bounds.
    """
    per = items.groupBy(by).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(cost).cast("bigint").alias("c")))).alias("xs"))
    zero = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast(f"array<{dict(items.dtypes)[order]}>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["c"] <= cap
        return F.struct(F.when(fits, acc["used"] + x["c"]).otherwise(acc["used"]).alias("used"), F.when(fits, F.array_append(acc["kept"], x["o"])).otherwise(acc["kept"]).alias("kept"))

    out = per.select(by, F.size("xs").alias("n"), F.aggregate("xs", zero, step).alias("r"))
    return out.select(by, "n", "r.used", "r.kept")


def head_tail(events: DataFrame, by: list[str], order: str, edge: int = 8) -> DataFrame:
    """First and last ``edge`` events of each group and how many were left out."""
    up, down = Window.partitionBy(*by).orderBy(order), Window.partitionBy(*by).orderBy(F.desc(order))
    n = F.count("*").over(Window.partitionBy(*by))
    rows = events.select("*", F.row_number().over(up).alias("at"), F.row_number().over(down).alias("from_end"), n.alias("n"))
    return rows.where((F.col("at") <= edge) | (F.col("from_end") <= edge)).withColumn("elided", F.greatest(F.col("n") - 2 * edge, F.lit(0)))


def top_n(rows: DataFrame, by: list[str], metric: str, tie: str, n: int = 3) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(metric), tie)
    return rows.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= n)


def json_tokens(row: Column) -> Column:
    return est_tokens(F.to_json(row))
