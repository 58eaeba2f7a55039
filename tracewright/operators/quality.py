"""Contracts of findings, payloads, units and debriefs as violation rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import basename
from ..schemas import FINDING_KINDS

TIERS, CONFIDENCES = ["T1", "T2", "T3"], ["high", "medium", "low"]


def violations(rows: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """(keys, rule) for every rule whose condition holds on a row."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    return rows.select(*keys, F.explode(found).alias("rule"))


def check_findings(findings: DataFrame) -> DataFrame:
    return violations(findings, ["unit_id", "kind"], {
        "kind": ~F.col("kind").isin(FINDING_KINDS) | F.col("kind").isNull(), "tier": ~F.col("tier").isin(TIERS) | F.col("tier").isNull(), "confidence": ~F.col("confidence").isin(CONFIDENCES) | F.col("confidence").isNull(),
        "note": ~F.col("exact") & F.col("note").isNull(), "idxs": F.col("idxs").isNull() | (F.size("idxs") == 0) | F.exists("idxs", lambda x: x < 0),
    })


def check_payloads(payloads: DataFrame, cap_tokens: int) -> DataFrame:
    """Payload rows (unit_id, json) against the version, ranking, size and flag rules."""
    v = F.try_parse_json("json")
    return violations(payloads, ["unit_id"], {
        "unreadable": v.isNull(), "version": v.isNotNull() & F.try_variant_get(v, "$.version", "bigint").isNull(), "truncated": v.isNotNull() & F.try_variant_get(v, "$.truncated", "boolean").isNull(),
        "edits": v.isNotNull() & F.coalesce(F.try_variant_get(v, "$.edits", "bigint") < 0, F.lit(True)), "too_large": F.ceil(F.octet_length("json") / 3.5) > cap_tokens,
    })


PROVENANCE = ["tool_use_id", "explicit", "cli_latest"]


def _at(v: Column, path: str, kind: str, of: str) -> Column:
    """A value at a path if it is of that JSON type, else null."""
    x = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(x) == of, F.try_variant_get(v, path, kind))


def _elements(payloads: DataFrame, of: Column) -> DataFrame:
    """(unit_id, pos, value) of the elements of a payload's array, none where it is no array."""
    rows = payloads.select("unit_id", of.alias("_array")).where("schema_of_variant(_array) LIKE 'ARRAY%'")
    return rows.sparkSession.sql("SELECT p.unit_id, e.pos, e.value FROM {p} p, LATERAL variant_explode(p._array) e", p=rows)


def check_reports(payloads: DataFrame, cap_tokens: int, provenance: list[str] = PROVENANCE) -> DataFrame:
    """(unit_id, rule, place) of what is wrong in report payloads (unit_id, json), place the path of the value.

    Every payload: version 2, a session with id and provenance, a true or false for truncated, the size. With files: a
    ranking rule, a breakdown somewhere, class and edits and no score in each, and findings of known kind, tier and
    confidence that cite indices. With a work unit: a gap fewer than sessions, ids of 8 characters, one each, a rule.
    """
    v = F.col("v")
    p = payloads.withColumn("v", F.try_parse_json("json"))
    ok = v.isNotNull()
    ranked = ok & F.coalesce(F.schema_of_variant(F.try_variant_get(v, "$.files", "variant")).startswith("ARRAY"), F.lit(False))
    unit = ok & F.try_variant_get(v, "$.work_unit", "variant").isNotNull()
    sessions, gaps, ids = _at(v, "$.work_unit.sessions", "bigint", "BIGINT"), F.try_variant_get(v, "$.work_unit.joined_gaps_min", "array<double>"), F.try_variant_get(v, "$.work_unit.session_ids", "array<string>")

    def empty(path: str) -> Column:
        return F.coalesce(F.trim(_at(v, path, "string", "STRING")), F.lit("")) == ""

    rules = {
        "unreadable": ("$", ~ok), "too_large": ("$", F.ceil(F.octet_length("json") / 3.5) > cap_tokens), "version": ("$.v", ok & ~_at(v, "$.v", "bigint", "BIGINT").eqNullSafe(2)),
        "session_id": ("$.session.id", ok & empty("$.session.id")), "provenance": ("$.session.identified_by", ok & ~F.coalesce(_at(v, "$.session.identified_by", "string", "STRING").isin(provenance), F.lit(False))),
        "truncated": ("$.truncated", ok & _at(v, "$.truncated", "boolean", "BOOLEAN").isNull()), "ranking_rule": ("$.ranking_rule", ranked & empty("$.ranking_rule")), "weights": ("$.weights", ranked & F.try_variant_get(v, "$.weights", "variant").isNotNull()),
        "unit_sessions": ("$.work_unit.sessions", unit & ~F.coalesce(sessions > 0, F.lit(False))), "unit_gaps": ("$.work_unit.joined_gaps_min", unit & (sessions > 0) & ~F.coalesce(F.size(gaps) == sessions - 1, F.lit(False))),
        "unit_ids": ("$.work_unit.session_ids", unit & (sessions > 0) & ~F.coalesce((F.size(ids) == sessions) & F.forall(ids, lambda i: F.length(i) == 8), F.lit(False))), "unit_rule": ("$.work_unit.rule", unit & empty("$.work_unit.rule")),
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(n).alias("rule"), F.lit(at).alias("place"))) for n, (at, c) in rules.items()]))
    out = p.select("unit_id", F.explode(found).alias("x")).select("unit_id", "x.*")

    files = _elements(p.where(ok), F.try_variant_get(v, "$.files", "variant")).withColumn("place", F.concat(F.lit("$.files["), F.col("pos").cast("string"), F.lit("]")))
    e = F.col("value")
    has = lambda k: F.try_variant_get(e, f"$.{k}", "variant").isNotNull()
    per = {"class": ~has("class"), "edits": ~has("edits"), "score": has("score")}
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in per.items()]))
    out = out.unionByName(files.select("unit_id", F.explode(found).alias("rule"), "place").select("unit_id", "rule", F.concat("place", F.lit("."), "rule").alias("place")))
    shown = files.groupBy("unit_id").agg(F.bool_or(has("breakdown")).alias("any"))
    out = out.unionByName(shown.where("not any").select("unit_id", F.lit("breakdown").alias("rule"), F.lit("$.files").alias("place")))

    inner = files.select(F.struct("unit_id", "place").alias("unit_id"), F.try_variant_get(e, "$.findings", "variant").alias("f"))
    f = _elements(inner, F.col("f"))
    indices = F.try_variant_get(e, "$.idxs", "array<bigint>")
    bad = {"kind": ~F.coalesce(_at(e, "$.kind", "string", "STRING").isin(FINDING_KINDS), F.lit(False)), "tier": ~F.coalesce(_at(e, "$.tier", "string", "STRING").isin(TIERS), F.lit(False)), "confidence": ~F.coalesce(_at(e, "$.confidence", "string", "STRING").isin(CONFIDENCES), F.lit(False)), "idxs": ~F.coalesce((F.size(indices) > 0) & F.forall(indices, lambda i: i >= 0), F.lit(False))}
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in bad.items()]))
    of = f.select("unit_id", "pos", F.explode(found).alias("rule"))
    return out.unionByName(of.select("unit_id.unit_id", F.concat(F.lit("finding_"), "rule").alias("rule"), F.concat("unit_id.place", F.lit(".findings["), F.col("pos").cast("string"), F.lit("]."), "rule").alias("place")))


def check_top_files(debriefs: DataFrame, files: DataFrame) -> DataFrame:
    """(unit_id, rule, file): ranked files (unit_id, file) whose base name a debrief (unit_id, text) doesn't mention."""
    both = files.select("unit_id", "file").distinct().join(debriefs.select("unit_id", "text"), "unit_id")
    return both.where(~F.coalesce(F.contains("text", basename(F.col("file"))), F.lit(False))).select("unit_id", F.lit("missing_file").alias("rule"), "file")


def check_units(units: DataFrame) -> DataFrame:
    return violations(units, ["project", "unit"], {
        "gaps": F.col("gaps") != F.col("sessions") - 1, "ids": F.col("ids") != F.col("sessions"), "negative": (F.col("dropped") < 0) | (F.col("sessions") < 1),
    })


def check_debriefs(debriefs: DataFrame, real: DataFrame, words: list[str], cap_tokens: int = 500) -> DataFrame:
    """Debriefs (unit_id, text): short, citing three or more actions, all real, with two signal words or more."""
    cited = debriefs.select("unit_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"#(\d+)"), F.lit(1)))).alias("i")).select("unit_id", F.col("i").cast("bigint").alias("idx"))
    fake = cited.join(real.select("unit_id", "idx"), ["unit_id", "idx"], "left_anti").groupBy("unit_id").agg(F.count("*").alias("fake"))
    n = cited.groupBy("unit_id").agg(F.count("*").alias("cited"))
    used = sum((F.contains(F.lower("text"), F.lit(w)).cast("int") for w in words), F.lit(0))
    rows = debriefs.join(n, "unit_id", "left").join(fake, "unit_id", "left").withColumn("words", used)
    return violations(rows, ["unit_id"], {
        "too_long": F.ceil(F.octet_length("text") / 3.5) > cap_tokens, "few_citations": F.coalesce("cited", F.lit(0)) < 3, "fabricated": F.coalesce("fake", F.lit(0)) > 0, "few_words": F.col("words") < 2,
    })
