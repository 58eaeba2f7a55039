"""Scalar functions and predicates, all Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession, functions as F

# Path classes, secret names, token prefixes and phrases that results depend on.
CODE_EXT = ["rs", "py", "ts", "tsx", "js", "jsx", "go", "java", "c", "h", "cc", "cpp", "hpp", "rb", "swift", "kt", "sh", "bash", "zsh", "sql", "vue", "svelte", "cs", "php", "lua", "scala", "dart", "ex", "exs", "clj", "hs", "ml", "m", "mm", "r", "pl"]
WEB_EXT = ["html", "css", "scss", "sass", "less"]
DOCS_EXT = ["md", "mdx", "txt", "rst", "adoc", "tex"]
CONFIG_EXT = ["json", "toml", "yaml", "yml", "ini", "cfg", "conf", "env", "lock", "properties", "gradle", "xml", "plist"]
SECRET_NAMES = [".netrc", ".pgpass", "credentials"]
KEYPAIR_PREFIXES = ["id_rsa", "id_ed25519", "id_ecdsa", "id_dsa"]
SECRET_EXT = ["pem", "key", "p12", "pfx"]
SECRET_PREFIXES = ["sk-", "sk_live_", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "xoxb-", "xoxp-", "xoxa-", "xoxs-", "glpat-", "AKIA", "eyJ"]
SENSITIVE_KEYS = ["key", "token", "secret", "passw", "credential", "auth"]
VALIDATION = ["test", "lint", "build", "tsc", "typecheck", "cargo check", "pytest", "clippy"]
RUNNERS = ["cargo test", "cargo build", "pytest", "npm test", "npm run build", "go test", "make"]
PUSHBACK = ["no ", "don't", "do not", "wrong", "revert", "undo", "instead", "not what"]
SEVERITY = ["failure_loops", "fumbles", "rework", "churn", "re_read", "action_loops"]
SPACES = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def contains_any(text: Column, needles: list[str]) -> Column:
    """Null where the text is."""
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(text, F.lit(n))
    return out


def norm_cap(s: Column, cap: int = 2000) -> Column:
    """White space collapsed and trimmed, the first ``cap`` characters, null if nothing is left."""
    return F.nullif(F.left(F.trim(F.regexp_replace(s, SPACES, " ")), F.lit(cap)), F.lit(""))


def latency_secs(a: Column, b: Column) -> Column:
    """Seconds between two ISO stamps of one date, null across dates or backwards."""
    secs = F.try_to_timestamp(b).cast("double") - F.try_to_timestamp(a).cast("double")
    return F.when((F.left(a, F.lit(10)) == F.left(b, F.lit(10))) & (secs >= 0), secs)


def hash_call(name: Column, args: Column) -> Column:
    return F.xxhash64(name, F.to_json(args) if not isinstance(args, str) else args)


def ts_secs(s: Column) -> Column:
    return F.unix_seconds(F.try_to_timestamp(s))


def to_epoch_secs(s: Column) -> Column:
    """Epoch of a UTC stamp's first 19 characters; fractions and offsets are not read."""
    return F.unix_seconds(F.try_to_timestamp(F.concat(F.left(s, F.lit(19)), F.lit("Z"))))


def duration_min(first: Column, last: Column) -> Column:
    return F.when(last >= first, F.floor((last - first) / 60))


def est_tokens(json: Column) -> Column:
    return F.ceil(F.octet_length(json) / 3.5)


def elide_middle(s: Column, cap: int) -> Column:
    half = cap // 2
    n = F.length(s)
    cut = F.concat(F.left(s, F.lit(half)), F.lit("…["), (n - 2 * half).cast("string"), F.lit(" chars elided]…"), F.right(s, F.lit(half)))
    return F.when(n > cap, cut).otherwise(s)


def short_id(s: Column) -> Column:
    return F.left(s, F.lit(8))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """After the last dot of the basename, null without one."""
    b = basename(path)
    return F.when(F.contains(b, F.lit(".")), F.substring_index(b, ".", -1))


def is_secrets(path: Column) -> Column:
    low = F.lower(path)
    name = basename(low)
    ext = F.coalesce(extension(low), F.lit(""))
    keypair = F.lit(False)
    for p in KEYPAIR_PREFIXES:
        keypair = keypair | name.startswith(p)
    return (
        (name == ".env") | name.startswith(".env.") | name.isin(SECRET_NAMES) | (keypair & (ext == ""))
        | (name.startswith("secrets.") & ~ext.isin(DOCS_EXT)) | ext.isin(SECRET_EXT)
    )


def classify_path(path: Column) -> Column:
    low = F.lower(path)
    ext = extension(low)
    return (
        F.when(is_secrets(path), "config")
        .when(F.contains(low, F.lit("/memory/")) | F.contains(low, F.lit("/notes/")), "notes")
        .when(ext.isNull(), "other")
        .when(basename(low).startswith("memory.") & ext.isin(DOCS_EXT), "notes")
        .when(ext.isin(CODE_EXT), "code")
        .when(ext.isin(DOCS_EXT), "docs")
        .when(ext.isin(CONFIG_EXT), "config")
        .when(ext.isin(WEB_EXT), "web")
        .otherwise("other")
    )


def class_tier(cls: Column) -> Column:
    return F.when(cls.isin("code", "web"), 0).when(cls == "notes", 1).when(cls == "docs", 2).otherwise(3)


def _redact_word(word: Column, before: Column) -> Column:
    prefixed = word.rlike("^(" + "|".join(SECRET_PREFIXES) + ")")
    key = F.regexp_extract(word, "^([^=:]*)[=:]", 1)
    rest = F.octet_length(word) - F.octet_length(key)
    sensitive = word.rlike("^[^=:]*[=:]") & (rest > 1) & F.lower(key).rlike("|".join(SENSITIVE_KEYS))
    hidden = (F.lower(before) == "bearer") | ((F.octet_length(word) >= 16) & prefixed)
    return F.when(hidden, "[REDACTED]").when(sensitive, F.concat(key, F.substr(word, F.length(key) + 1, F.lit(1)), F.lit("[REDACTED]"))).otherwise(word)


def redact(s: Column) -> Column:
    """PEM blocks, bearer and prefixed tokens and values of sensitive keys replaced; spaces collapse within lines."""
    text = F.regexp_replace(s, r"(?s)-----BEGIN(?:.*?-----END.*?-----|.*)", "[REDACTED:pem]")

    def line(x: Column) -> Column:
        one = F.trim(F.regexp_replace(x, SPACES, " "))
        words = F.filter(F.split(one, " "), lambda w: w != "")
        before = F.concat(F.array(F.lit("")), words)  # one longer: its last pairs with null, which the join skips
        # few lines have anything to hide; only those are taken apart
        return F.when(one.rlike("(?i)bearer|[=:]|(?-i:" + "|".join(SECRET_PREFIXES) + ")"), F.array_join(F.zip_with(words, before, _redact_word), " ")).otherwise(one)

    return F.array_join(F.transform(F.split(text, "\n"), line), "\n")


def excerpt(command: Column, error: Column, edit_new: Column, cap: int = 600) -> Column:
    return redact(F.left(F.coalesce(command, error, edit_new), F.lit(cap)))


def category_phrase(category: Column, n: Column) -> Column:
    count, s = n.cast("string"), F.when(n == 1, "").otherwise("s")
    return (
        F.when(category == "churn", F.concat(F.lit("rewritten "), count, F.lit("x")))
        .when(category == "rework", F.concat(F.lit("reworked "), count, F.lit("x")))
        .when(category == "re_read", F.concat(F.lit("re-read "), count, F.lit("x")))
        .when(category == "failure_loops", F.concat(count, F.lit(" looped failing command"), s))
        .when(category == "fumbles", F.concat(count, F.lit(" blind-write attempt"), s))
        .when(category == "action_loops", F.concat(count, F.lit(" repeated-call loop"), s))
        .otherwise(F.concat(category, F.lit(" "), count))
    )


def fmt_thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def fmt_duration(minutes: Column) -> Column:
    h, m = F.floor(minutes / 60), minutes % 60
    return F.when(h > 0, F.concat(h.cast("string"), F.lit("h "), F.lpad(m.cast("string"), 2, "0"), F.lit("m"))).otherwise(F.concat(m.cast("string"), F.lit("m")))


def rfc3339_utc(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def edit_stratum(edits: Column) -> Column:
    return F.when(edits <= 1, "1").when(edits <= 3, "2-3").otherwise("4+")


def fingerprint(x: Column) -> Column:
    return F.left(F.sha2(x, 256), F.lit(16))


def is_edit(kind: Column) -> Column:
    return kind.isin("Edit", "Write")


def is_validation(command: Column) -> Column:
    return contains_any(F.lower(command), VALIDATION)


def is_pushback(text: Column) -> Column:
    return contains_any(F.lower(text), PUSHBACK)


def is_boundary_turn(origin: Column) -> Column:
    return origin.isin("Human", "Unknown")


def is_quotable_turn(origin: Column) -> Column:
    return origin == "Human"


def is_interrupt(text: Column) -> Column:
    return text.startswith("[Request interrupted by user")


def line_count(text: Column) -> Column:
    """Lines as a text reader gives them: a last line end opens no line."""
    return F.when(text == "", 0).otherwise(F.size(F.split(text, "\n", -1)) - F.when(text.endswith("\n"), 1).otherwise(0))


_OPERATOR = re.compile(r"(?<![\w`])(<=>|<=|>=|=|<|>|!|\+|-|\*|/|%|and|or|in|not)\(")


def sql_of(column: Column) -> str:
    """A Column as SQL text: operators, which print as functions of their names, are quoted as such outside of literals."""
    parts = re.split(r"('(?:[^'\\]|\\.)*')", column._jc.node().sql(), flags=re.S)
    return "".join(x if i % 2 else _OPERATOR.sub(r"`\1`(", x) for i, x in enumerate(parts))


#: name -> (arguments, result, Column of them)
SQL_FUNCTIONS = {
    "norm_cap": ("s STRING", "STRING", lambda: norm_cap(F.col("s"))),
    "elide_middle_160": ("s STRING", "STRING", lambda: elide_middle(F.col("s"), 160)),
    "redact": ("s STRING", "STRING", lambda: redact(F.col("s"))),
    "classify_path": ("p STRING", "STRING", lambda: classify_path(F.col("p"))),
    "is_secrets": ("p STRING", "BOOLEAN", lambda: is_secrets(F.col("p"))),
    "est_tokens": ("j STRING", "BIGINT", lambda: est_tokens(F.col("j"))),
    "short_id": ("s STRING", "STRING", lambda: F.left("s", F.lit(8))),
    "latency_secs": ("a STRING, b STRING", "DOUBLE", lambda: latency_secs(F.col("a"), F.col("b"))),
}


def register_sql(spark: SparkSession) -> None:
    """The scalar functions as temporary SQL functions, each from the Column that the engine itself uses."""
    for name, (given, result, column) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({given}) RETURNS {result} RETURN {sql_of(column())}")
