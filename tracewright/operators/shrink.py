"""Payloads that are cut until their serialised text fits a cap: files first, then findings a file.

Every entry is serialised once; running sums of the lengths give the size of the payload at each cut, and the
largest cut that fits is taken. So no payload is built to be thrown away, and what is kept is measured exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import elide_middle
from . import rank

FILES_MAX, PER_FILE, IDXS_MAX, PATH_MAX, CAP_TOKENS = 20, 4, 10, 160, 1500
CHARS_PER_TOKEN = 3.5
RANKING_RULE = "edited files first, then code before docs and config, then by edit count, ties by path"


def fits(size: Column, cap: int) -> Column:
    return F.ceil(size / CHARS_PER_TOKEN) <= cap


def _finding(extra: tuple[str, ...]) -> Column:
    """A finding's JSON: its first indices, how many there are if that is not all, its capped path."""
    more = F.when(F.size("idxs") > IDXS_MAX, F.size("idxs"))
    return F.to_json(F.struct("kind", "tier", "exact", "confidence", F.slice("idxs", 1, IDXS_MAX).alias("idxs"), more.alias("idxs_total"), elide_middle(F.col("file"), PATH_MAX).alias("file"), *extra))


def _entry(p: int) -> Column:
    """A file's JSON with at most ``p`` of its findings."""
    kept = F.slice("found", 1, p) if p else F.array().cast("array<string>")
    left = F.col("n_findings") - F.size(kept)
    return F.concat(F.substring("head", F.lit(1), F.length("head") - 1), F.lit(',"findings":['), F.array_join(kept, ","), F.lit("]"), F.when(left > 0, F.concat(F.lit(',"findings_omitted":'), left.cast("string"))).otherwise(""), F.lit("}"))


def entries(findings: DataFrame, ranked: DataFrame, n: int = FILES_MAX, extra: tuple[str, ...] = ("note", "nums")) -> DataFrame:
    """(unit_id, rank, files_total, cut, n_findings, e0 to e4): each ranked file's JSON at every cut of its findings.

    cut says that a path or a list of indices was capped, of the findings kept or not.
    """
    n = min(n, FILES_MAX)
    rows = rank.representative_findings(findings, 1 << 30).withColumn("json", _finding(extra)).withColumn("capped", (F.size("idxs") > IDXS_MAX) | (F.length("file") > PATH_MAX))
    some = F.transform(F.sort_array(F.collect_list(F.when(F.col("slot") <= PER_FILE, F.struct("slot", "json")))), lambda x: x["json"])
    per = rows.groupBy("unit_id", "file").agg(some.alias("found"), F.count("*").alias("n_findings"), F.bool_or("capped").alias("capped"))
    files = ranked.withColumn("files_total", F.count("*").over(Window.partitionBy("unit_id"))).where(F.col("rank") <= n).join(per, ["unit_id", "file"], "left")
    files = files.withColumns({"found": F.coalesce("found", F.array().cast("array<string>")), "n_findings": F.coalesce("n_findings", F.lit(0)), "cut": F.coalesce("capped", F.lit(False)) | (F.length("file") > PATH_MAX)})
    breakdown = F.map_from_entries(F.sort_array(F.map_entries("breakdown")))
    files = files.withColumn("head", F.to_json(F.struct("rank", elide_middle(F.col("file"), PATH_MAX).alias("file"), "class", "edits", breakdown.alias("breakdown"))))
    return files.select("unit_id", "rank", "files_total", "cut", "n_findings", *[_entry(p).alias(f"e{p}") for p in range(PER_FILE + 1)])


def _before(session: Column) -> Column:
    return F.concat(F.lit('{"v":2,"session":'), session, F.lit(f',"ranking_rule":"{RANKING_RULE}","files":['))


def _after(total: Column, p: Column, truncated: Column) -> Column:
    return F.concat(F.lit('],"files_total":'), total.cast("string"), F.lit(f',"n_max":{FILES_MAX},"findings_per_file_cap":'), p.cast("string"), F.lit(',"truncated":'), truncated.cast("string"), F.lit("}"))


def struggle_payloads(units: DataFrame, findings: DataFrame, ranked: DataFrame, n: int = FILES_MAX, cap: int = CAP_TOKENS, extra: tuple[str, ...] = ("note", "nums")) -> DataFrame:
    """(unit_id, files, per_file, payload) of every unit of (unit_id, session), session a JSON text.

    The lowest ranked files go first; findings a file only once a single file is left.
    """
    rows = entries(findings, ranked, n, extra).join(units.select("unit_id", "session"), "unit_id")
    w = Window.partitionBy("unit_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)

    def size(p: int, used: Column, hidden: Column) -> Column:
        truncated = (F.col("files_total") > F.col("rank")) | hidden
        return F.octet_length(_before(F.col("session"))) + used + F.octet_length(_after(F.col("files_total"), F.lit(p), truncated))

    hides = F.bool_or(F.col("cut") | (F.col("n_findings") > PER_FILE)).over(w)
    used = F.sum(F.octet_length(f"e{PER_FILE}")).over(w) + F.col("rank") - 1
    rows = rows.withColumn("hidden", hides).withColumn("fits", fits(size(PER_FILE, used, F.col("hidden")), cap))
    fewer = F.coalesce(*[F.when(fits(size(p, F.octet_length(f"e{p}"), F.col("cut") | (F.col("n_findings") > p)), cap), p) for p in range(PER_FILE - 1, 0, -1)], F.lit(0))
    best = rows.groupBy("unit_id").agg(F.coalesce(F.max(F.when(F.col("fits"), F.col("rank"))), F.lit(1)).alias("files"), F.max(F.when(F.col("rank") == 1, fewer)).alias("first"), F.bool_or("fits").alias("any"))
    best = best.select("unit_id", "files", F.when(F.col("any"), PER_FILE).otherwise(F.col("first")).alias("per_file"))
    kept = rows.join(best, "unit_id").where(F.col("rank") <= F.col("files"))
    entry = F.element_at(F.array(*[F.col(f"e{p}") for p in range(PER_FILE + 1)]), F.col("per_file") + 1)
    hidden = F.bool_or(F.col("cut") | (F.col("n_findings") > F.col("per_file")) | (F.col("files_total") > F.col("files")))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", entry.alias("e")))), lambda x: x["e"]), ",")
    made = kept.groupBy("unit_id", "session", "files", "per_file").agg(F.max("files_total").alias("total"), hidden.alias("truncated"), body.alias("body"))
    made = made.select("unit_id", "files", "per_file", F.concat(_before(F.col("session")), "body", _after(F.col("total"), F.col("per_file"), F.col("truncated"))).alias("payload"))
    bare = F.concat(_before(F.col("session")), _after(F.lit(0), F.lit(PER_FILE), F.lit(False)))
    return units.select("unit_id", "session").join(made, "unit_id", "left").select("unit_id", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("per_file", F.lit(PER_FILE)).alias("per_file"), F.coalesce("payload", bare).alias("payload"))
