"""Secrets in texts, and whether they belong to one owner or are copied by all.

Patterns propose candidates. The hash of each candidate's value is counted over
the whole corpus by distinct repositories and owners: a value that many owners
have is an example out of some manual, one that a single owner has is likely to
be live. All of it is DataFrame work; texts are read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from argloom.llm import spans as S
from argloom.session import materialize

BASE = ["assign", "access", "hex"]
_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)"""
# A private key: from its first line to its last or, where that is missing, over the base64 that follows. Lines
# may end in an escaped "\\n" or stand in quotes or comments, as in settings and source code.
_BASE64 = "[A-Za-z0-9+/=]{16,}+"
_BREAK = r"(?:[\x20\x09-\x0D\"'`,;#>*]|\\++[nrt]?+){1,64}+"
_PEM_LINE = r"-----{} [A-Z ]{{0,20}}PRIVATE KEY-----"
_HEADERS = r"[A-Za-z-]{1,30}+:\x20[^\x0A\\]*+"
_PEM = (
    _PEM_LINE.format("BEGIN")
    + rf"(?:(?s:(?!-----).)*+{_PEM_LINE.format('END')}|{_BREAK}(?:{_HEADERS}{_BREAK})*+{_BASE64}(?:{_BREAK}{_BASE64})*+)"
)
# Published key formats.
MORE = {
    "github": r"gh[pousr]_[A-Za-z0-9]{36,}+",
    "slack": r"xox[abprs]-[A-Za-z0-9-]{10,}+",
    "google": r"AIza[0-9A-Za-z_-]{35}+",
    "stripe": r"[rs]k_live_[0-9A-Za-z]{16,}+",
    "jwt": r"eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]++",
    "pem": _PEM,
    "login": r"://[A-Za-z0-9._%+-]{1,64}+:[^\x20\x09-\x0D/@:]{6,128}+@",
    "bearer": r"(?i:bearer)\x20{1,4}+[A-Za-z0-9._~+/=-]{20,}+",
}
ORDER = [*BASE, *MORE]
SALTS = 32
_PLACEHOLDER = r"(?i)example|changeme|placeholder|dummy|your[_-]|x{6,}|\*{4,}|123456"


def base_spans(text: Column) -> Column:
    """The three base kinds; matches that are too short are dropped."""
    assign = F.filter(
        S.find(text, "assign", _ASSIGN), lambda s: F.length(F.regexp_extract(s["value"], _ASSIGN, 2)) >= 6
    )
    access = F.filter(
        S.find(text, "access", "AKIA[A-Z0-9]++", text.contains("AKIA")), lambda s: F.length(s["value"]) >= 20
    )
    return F.concat(assign, access, S.find(text, "hex", "[0-9a-f]{24,}+"))


def more_spans(text: Column) -> Column:
    found = F.concat(*[S.find(text, kind, pattern) for kind, pattern in MORE.items()])
    return F.filter(found, lambda s: (s["kind"] != "pem") | _key_body(s["value"]).rlike(_BASE64))


def _key_body(match: Column) -> Column:
    """The base64 of a private key alone, the same however its lines are broken, quoted or commented."""
    lines = F.regexp_replace(F.regexp_replace(match, "-----[A-Z ]++-----", "\n"), r"\\++[nrt]", "\n")
    lines = F.regexp_replace(lines, rf"(?m)^[\x20\x09]*+{_HEADERS}$|[\"'][\x20\x09]*+\+(?=[\x20\x09-\x0D\"'])|^[\x20\x09]*+//++[\x20\x09]", "")
    return F.regexp_replace(lines, "[^A-Za-z0-9+/=]++", "")


def _value(span: Column) -> Column:
    """The secret itself: what is assigned, the body of a private key, or the whole match."""
    assigned = F.when(span["kind"] == "assign", F.regexp_extract(span["value"], _ASSIGN, 2))
    return assigned.when(span["kind"] == "pem", _key_body(span["value"])).otherwise(span["value"])


def _looks_live(value: Column) -> Column:
    varied = F.size(F.array_distinct(F.split(value, ""))) >= 8
    return varied & ~value.rlike(_PLACEHOLDER)


def scan(
    df: DataFrame,
    owner: Column,
    repository: Column,
    key: str = "doc_id",
    text: str = "text",
    max_owners: int = 2,
    max_repositories: int = 4,
) -> DataFrame:
    """``key, spans``: every secret with its kind, place, value, number of owners and
    repositories that hold the same value, and a verdict.

    Verdicts: ``copied`` beyond either maximum, ``placeholder`` for values of
    little variety, else ``owner``. Base kinds are always reported, further
    kinds only with the verdict ``owner``. Null text has no secrets; a null
    owner or repository is one of its own. Rows with equal keys are separate
    documents. An empty table gives an empty result.
    """
    rows = df.select(
        F.col(key).alias("_key"),
        F.coalesce(owner.cast("string"), F.lit("")).alias("_owner"),
        F.coalesce(repository.cast("string"), F.lit("")).alias("_repository"),
        S.plain(F.col(text)).alias("_text"),
    )
    both = F.concat(base_spans(F.col("_text")), more_spans(F.col("_text")))
    found = F.transform(
        both,
        lambda s: F.struct(
            s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), _value(s).alias("value")
        ),
    )
    # Written once: the row number must not change if a lost executor's work is repeated.
    rows = rows.select("_key", "_owner", "_repository", found.alias("_found"))
    rows = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "secrets")
    full = rows.where(F.size("_found") > 0)
    each = full.select("_row", "_owner", "_repository", F.explode("_found").alias("s"))
    each = each.select("_row", "_owner", "_repository", "s.*", F.sha2("s.value", 256).alias("_hash"))
    by_repository = each.groupBy("_hash", "_owner", "_repository").agg(F.lit(1).alias("_one"))
    by_owner = by_repository.groupBy("_hash", "_owner").agg(F.count("*").alias("_n"))
    counts = by_owner.groupBy("_hash").agg(F.count("*").alias("owners"), F.sum("_n").alias("repositories"))
    copied = (F.col("owners") > max_owners) | (F.col("repositories") > max_repositories)
    verdict = F.when(copied, "copied").when(_looks_live(F.col("value")), "owner").otherwise("placeholder")
    # A value in a third of all documents is joined in parts.
    salted = counts.withColumn("_salt", F.explode(F.array(*[F.lit(n).cast("bigint") for n in range(SALTS)])))
    judged = each.withColumn("_salt", F.pmod("_row", F.lit(SALTS))).join(salted, ["_hash", "_salt"])
    judged = judged.withColumn("verdict", verdict)
    judged = judged.where(F.col("kind").isin(BASE) | (F.col("verdict") == "owner"))
    fields = ["kind", "start", "end", "value", "owners", "repositories", "verdict"]
    per_row = judged.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", *fields[3:]))).alias("_spans"))
    shaped = F.transform("_spans", lambda s: F.struct(*[s[f].alias(f) for f in fields]))
    empty = "array<struct<kind:string,start:bigint,end:bigint,value:string,owners:bigint,repositories:bigint,verdict:string>>"
    with_some = full.select("_key", "_row").join(per_row, "_row", "left").select("_key", shaped.alias("spans"))
    without = rows.where(F.size("_found") == 0).select("_key", F.lit(None).cast(empty).alias("spans"))
    return with_some.unionByName(without).select(
        F.col("_key").alias(key), F.coalesce("spans", F.array().cast(empty)).alias("spans")
    )


def digest(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, digest and list of the spans of every row."""
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"].isin(BASE))

    def verdicts(name: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["verdict"] == name)).cast("bigint")

    return scanned.select(
        key,
        *[S.of_kind(base, kind).alias(f"n_{kind}") for kind in BASE],
        F.sha2(S.listed(base, ORDER, by_kind=False), 256).alias("base_sha256"),
        S.listed(spans, ORDER, by_kind=False).alias("spans"),
        verdicts("owner").alias("n_owner"),
        verdicts("copied").alias("n_copied"),
    )
