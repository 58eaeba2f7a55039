"""Outcome studies over sessions: pairs, contingency tables, relative risk, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import edit_stratum
from . import rank, relations
from .order_stats import ranked_values, upper_median

# The rules, windows and outcomes that the study compares, and its smallest sound cell.
PRODUCT_RULES = ["flagged_nr", "flagged_top3"]
BASELINE_RULES = ["base_edits_ge2", "base_edits_ge4", "base_top3_edits", "base_lines_ge200", "base_lines_ge400", "base_top3_lines", "base_failed_ge1", "base_all"]
RULES = PRODUCT_RULES + BASELINE_RULES
WINDOWS = ["next3", "within14d"]
OUTCOMES = ["weak", "strong"]
MIN_CELL = 5
# Kinds that make a later session a strong outcome, the fewest actions and the least age of a session studied.
STRONG_KINDS = ["failure_loop", "user_corrected", "true_revert", "flip"]
MIN_ACTIONS = 20
RECENT_S = 600


def session_records(actions: DataFrame) -> DataFrame:
    """(unit_id, actions, failed, start): what a session did, and the epoch second of its first action.

    Where the first action has no stamp, the latest stamp stands for it; with none at all ``start`` is null.
    """
    def seconds(ts: Column) -> Column:
        return F.unix_seconds(F.try_to_timestamp(ts))

    failed = (F.col("kind") == "Bash") & F.coalesce("is_error", F.lit(False))
    first = F.coalesce(seconds(F.min_by("effective_ts", "idx")), seconds(F.max("effective_ts")))
    return actions.groupBy("unit_id").agg(F.count("*").alias("actions"), F.count_if(failed).alias("failed"), first.alias("start"))


def file_records(actions: DataFrame, findings: DataFrame, ranked: DataFrame, review: DataFrame, verified: DataFrame) -> DataFrame:
    """A row an edited file of a session: edits, confirmed lines, kinds of findings, both product flags, whether it was looked at after.

    ``review`` is the list of needs_review, ``ranked`` that of rank_files, whose first three are the second flag.
    """
    keys = ["unit_id", "file"]
    per = findings.where("file is not null").groupBy(*keys).agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    rows = rank.edit_counts(actions).join(relations.changed_lines(actions).withColumnRenamed("changed_lines", "lines"), keys, "left").join(per, keys, "left")
    rows = rows.join(review.select(*keys, F.lit(True).alias("flagged_nr")), keys, "left").join(ranked.where("rank <= 3").select(*keys, F.lit(True).alias("flagged_top3")), keys, "left")
    rows = rows.join(verified.select("unit_id", F.col("file_path").alias("file"), "verified"), keys, "left")
    none = F.array().cast("array<string>")
    return rows.withColumns({"lines": F.coalesce("lines", F.lit(0)).cast("bigint"), "kinds": F.coalesce("kinds", none), **{c: F.coalesce(c, F.lit(False)) for c in ("flagged_nr", "flagged_top3", "verified")}})


def corpus_filter(sessions: DataFrame, now: Column, min_actions: int = MIN_ACTIONS, recent_s: int = RECENT_S) -> DataFrame:
    """Sessions of (actions, modified) with ``excluded``: 'recent' while they may still change, 'low_actions', or null where they stay."""
    return sessions.withColumn("excluded", F.when(now - F.col("modified") < recent_s, "recent").when(F.col("actions") < min_actions, "low_actions"))


def number_sessions(sessions: DataFrame) -> DataFrame:
    """Sessions of (project, unit_id, start) with their place in the project, ``seq``, and its last one, ``last_seq``."""
    rows = sessions.withColumn("seq", (F.row_number().over(Window.partitionBy("project").orderBy("start", "unit_id")) - 1).cast("bigint"))
    return rows.withColumn("last_seq", F.max("seq").over(Window.partitionBy("project")))


def build_pairs(files: DataFrame, next_k: int = 3, days: int = 14) -> DataFrame:
    """(session, edited file) rows with baselines and outcomes in later sessions of the project.

    ``files`` has project, seq, start (epoch), file, edits, lines, failed, flagged_nr, flagged_top3, and, where known,
    ``last_seq`` (the project's last session, whether or not it edits a file) and ``strong`` (a later row counts as a
    strong outcome; else flagged_nr tells). The last session of a project has no future and is left out. What comes later
    is the least place and the least start among a file's later sessions: running minima, so no session meets another.
    """
    w = Window.partitionBy("project", "seq")
    strong = F.col("strong") if "strong" in files.columns else F.col("flagged_nr")
    rows = files if "last_seq" in files.columns else files.withColumn("last_seq", F.max("seq").over(Window.partitionBy("project")))
    rows = rows.withColumn("by_edits", F.row_number().over(w.orderBy(F.desc("edits"), "file"))).withColumn("by_lines", F.row_number().over(w.orderBy(F.desc("lines"), "file")))
    later = Window.partitionBy("project", "file").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    near, soon = F.col("seq") + next_k, F.col("start") + days * 86400
    rows = rows.withColumns({
        "next3_weak": F.min("seq").over(later) <= near, "next3_strong": F.min(F.when(strong, F.col("seq"))).over(later) <= near,
        "within14d_weak": F.min("start").over(later) <= soon, "within14d_strong": F.min(F.when(strong, F.col("start"))).over(later) <= soon,
    })
    out = rows.where(F.col("seq") < F.col("last_seq"))
    out = out.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("next3_weak", "next3_strong", "within14d_weak", "within14d_strong")})
    return out.withColumns({
        "base_edits_ge2": F.col("edits") >= 2, "base_edits_ge4": F.col("edits") >= 4, "base_top3_edits": F.col("by_edits") <= 3, "base_lines_ge200": F.col("lines") >= 200,
        "base_lines_ge400": F.col("lines") >= 400, "base_top3_lines": F.col("by_lines") <= 3, "base_failed_ge1": F.col("failed") >= 1, "base_all": F.lit(True), "stratum": edit_stratum(F.col("edits")),
    }).drop("by_edits", "by_lines", "last_seq")


def contingency(pairs: DataFrame, by: list[str] | None = None, rules: list[str] | None = None) -> DataFrame:
    """a, b, c, d of every rule, window and outcome, in one pass over the pairs."""
    rules = rules or RULES
    flags = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("flag")) for r in rules])).alias("r")
    outs = F.explode(F.array(*[F.struct(F.lit(w).alias("window"), F.lit(o).alias("outcome"), F.col(f"{w}_{o}").alias("hit")) for w in WINDOWS for o in OUTCOMES])).alias("o")
    by = by or []
    long = pairs.select("*", flags).select("*", outs).select(*by, "r.*", "o.*")
    flag, hit = F.col("flag"), F.col("hit")
    return long.groupBy(*by, "rule", "window", "outcome").agg(F.count_if(flag & hit).alias("a"), F.count_if(flag & ~hit).alias("b"), F.count_if(~flag & hit).alias("c"), F.count_if(~flag & ~hit).alias("d"))


def relative_risk() -> Column:
    a, b, c, d = map(F.col, "abcd")
    return F.when((a + b > 0) & (c > 0), (a / F.nullif(a + b, F.lit(0))) / (c / F.nullif(c + d, F.lit(0))))


def precision() -> Column:
    return F.try_divide(F.col("a"), F.col("a") + F.col("b"))


def miss_rate() -> Column:
    return F.try_divide(F.col("c"), F.col("a") + F.col("c"))


def rr_interval() -> tuple[Column, Column]:
    """95% bounds by Katz's log method, null where a or c is 0."""
    a, b, c, d = map(F.col, "abcd")
    rr = relative_risk()
    se = F.sqrt(F.try_divide(F.lit(1), a) - F.try_divide(F.lit(1), a + b) + F.try_divide(F.lit(1), c) - F.try_divide(F.lit(1), c + d))
    ok = (a > 0) & (c > 0)
    return F.when(ok, F.exp(F.log(rr) - 1.96 * se)), F.when(ok, F.exp(F.log(rr) + 1.96 * se))


def thin_cells() -> Column:
    return F.array_join(F.filter(F.array(*[F.when(F.col(x) < MIN_CELL, F.lit(x)) for x in "abcd"]), lambda x: x.isNotNull()), ",")


def rule_comparison(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    lo, hi = rr_interval()
    t = contingency(pairs, by)
    return t.select("*", relative_risk().alias("rr"), lo.alias("rr_lo"), hi.alias("rr_hi"), precision().alias("precision"), miss_rate().alias("miss_rate"), thin_cells().alias("thin"), F.try_divide(F.col("a") + F.col("b"), F.col("a") + F.col("b") + F.col("c") + F.col("d")).alias("flag_share"))


def rule_agreement(pairs: DataFrame) -> DataFrame:
    """Where a product rule and a baseline agree or split, and how often the outcome followed."""
    both = F.explode(F.array(*[F.struct(F.lit(p).alias("product"), F.lit(b).alias("baseline"), F.col(p).alias("x"), F.col(b).alias("y")) for p in PRODUCT_RULES for b in BASELINE_RULES])).alias("r")
    rows = pairs.select("next3_strong", both).select("next3_strong", "r.*")
    bucket = F.when(F.col("x") & F.col("y"), "both").when(F.col("x"), "product_only").when(F.col("y"), "baseline_only").otherwise("neither")
    return rows.groupBy("product", "baseline", bucket.alias("bucket")).agg(F.count("*").alias("n"), F.count_if("next3_strong").alias("positive"), F.avg(F.col("next3_strong").cast("double")).alias("rate"))


def false_alarms(pairs: DataFrame) -> DataFrame:
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("flag")) for r in PRODUCT_RULES])).alias("r")
    return pairs.select("next3_weak", rules).where("r.flag").groupBy(F.col("r.rule").alias("rule")).agg(F.count("*").alias("flagged"), F.count_if(~F.col("next3_weak")).alias("no_future_edit"), F.avg((~F.col("next3_weak")).cast("double")).alias("share"))


def hypothesis(pairs: DataFrame) -> DataFrame:
    """Whether a look back after the last edit matters: the review flag within each stratum of ``verified``, and 'standalone' its lack alone."""
    flag, hit = F.col("flag"), F.col("next3_strong")
    views = F.explode(F.array(F.struct(F.when(F.col("verified"), "verified").otherwise("unverified").alias("view"), F.col("flagged_nr").alias("flag")), F.struct(F.lit("standalone").alias("view"), (~F.col("verified")).alias("flag")))).alias("x")
    t = pairs.select("next3_strong", views).select("next3_strong", "x.*").groupBy("view").agg(F.count_if(flag & hit).alias("a"), F.count_if(flag & ~hit).alias("b"), F.count_if(~flag & hit).alias("c"), F.count_if(~flag & ~hit).alias("d"))
    return t.select("*", relative_risk().alias("rr"), precision().alias("precision"))


def verdict(comparison: DataFrame) -> DataFrame:
    """Each product rule against the best baseline and the baselines at least as good in everything."""
    cell = comparison.where("window = 'next3' and outcome = 'strong'").select("rule", F.coalesce("rr", F.lit(0.0)).alias("rr"), F.coalesce("precision", F.lit(0.0)).alias("pr"), F.coalesce("miss_rate", F.lit(1.0)).alias("miss"), "rr_lo", "rr_hi")
    base = cell.where(F.col("rule").isin(BASELINE_RULES) & (F.col("rule") != "base_all"))
    best = base.agg(F.max_by(F.struct("rule", "rr", "rr_lo", "rr_hi"), F.struct("rr", "rule")).alias("best"))
    p = cell.where(F.col("rule").isin(PRODUCT_RULES)).select(*[F.col(c).alias(f"p_{c}") for c in cell.columns])
    # at most ten rules on either side
    over = p.join(base, (F.col("rr") >= F.col("p_rr")) & (F.col("pr") >= F.col("p_pr")) & (F.col("miss") <= F.col("p_miss")))
    over = over.groupBy("p_rule").agg(F.array_join(F.sort_array(F.collect_list("rule")), ",").alias("dominated_by"))
    out = p.join(F.broadcast(best)).join(over, "p_rule", "left")
    overlap = (F.col("p_rr_lo") <= F.col("best.rr_hi")) & (F.col("best.rr_lo") <= F.col("p_rr_hi"))
    return out.select(F.col("p_rule").alias("rule"), F.col("best.rule").alias("best_baseline"), (F.col("p_rr") > F.col("best.rr")).alias("beats_best"), overlap.alias("ci_overlaps"), F.coalesce("dominated_by", F.lit("")).alias("dominated_by"))


def anonymize(names: DataFrame, col: str = "project") -> DataFrame:
    """proj-NN by sorted name, numbered over ranges of the distinct names."""
    return ranked_values(names, col).select(F.col("value").alias(col), F.concat(F.lit("proj-"), F.when(F.col("number") < 10, "0").otherwise(""), F.col("number").cast("string")).alias("alias"))


def token_ratio(ratios: DataFrame) -> DataFrame:
    """(sessions, least, median, most) of (ratio); the upper median."""
    ends = ratios.agg(F.count("ratio").alias("sessions"), F.min("ratio").alias("least"), F.max("ratio").alias("most"))
    return ends.join(F.broadcast(upper_median(ratios, "ratio")), F.col("sessions") == F.col("rows")).select("sessions", "least", "median", "most")


def zero_fire(edits: DataFrame, ranked: DataFrame, least: int = 3) -> DataFrame:
    """(unit_id, edits): units of (unit_id, edits) with ``least`` edits or more and no ranked file."""
    return edits.where(F.col("edits") >= least).join(ranked.select("unit_id").distinct(), "unit_id", "left_anti")


def revisits(touches: DataFrame) -> DataFrame:
    """(project, file, sessions, revisits, shortest_gap, longest_gap) of (project, file, session_seq).

    A gap is how many of the project's sessions lie between two that follow each other among the file's; a file that
    the next session touches again has gap 0. Repeated rows count once.
    """
    once = touches.select("project", "file", "session_seq").distinct()
    before = F.lag("session_seq").over(Window.partitionBy("project", "file").orderBy("session_seq"))
    gap = F.col("session_seq") - F.col("before") - 1
    per = once.withColumn("before", before).groupBy("project", "file")
    return per.agg(F.count("*").alias("sessions"), F.count("before").alias("revisits"), F.min(gap).alias("shortest_gap"), F.max(gap).alias("longest_gap"))


def holdout(projects: DataFrame, frozen: list[str]) -> DataFrame:
    """Projects with whether their fingerprint is in the frozen list."""
    from ..functions.scalars import fingerprint

    return projects.withColumn("held_out", fingerprint(F.col("project").cast("string")).isin(frozen))
