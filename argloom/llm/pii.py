"""Personal data: many candidates, of which boosted trees choose the redactions.

Generators propose spans with high recall and may overlap. Every candidate gets
features of its own format and of the characters around it. Gradient-boosted
trees learn from candidates that strict patterns confirm and from those that are
surely none; loose forms that might be personal data are neither, and are what
the trees decide about. An isotonic regression on candidates kept apart turns
scores into probabilities, and a threshold on these selects. What the strict
patterns find is always reported. All of it is DataFrame and Spark ML work.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, functions as F

from argloom.llm import spans as S
from argloom.session import materialize

BASE = ["email", "ip", "card", "phone"]
# A match starts where its run of characters starts, or where the match before has ended. Anything
# else would only repeat the failure of the run, once per character.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Loose forms of the same data. Values longer than these bounds are none of it.
MORE = {
    "email_spelled": r"(?i)[a-z0-9._%+-]{1,64}\x20?[(\[{<]?\x20?(?:@|at)\x20?[)\]}>]?\x20?[a-z0-9-]{1,63}\x20?[(\[{<]?\x20?(?:\.|dot)\x20?[)\]}>]?\x20?(?:com|org|net|edu|gov|info|io|de|fr|es|uk)\b",
    "ip_spelled": r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:.])",
    "card_spelled": r"(?<![0-9])[0-9]{4}(?:[._/\x20-][0-9]{4}){2,3}(?:[._/\x20-][0-9]{1,3})?(?![0-9])",
    "phone_spelled": r"(?<![0-9+.])(?<![0-9][\x20./-])(?:00[1-9][0-9]{0,2}|\([0-9]{2,5}\)|0[0-9]{1,4})[\x20./-]{1,2}[0-9]{2,5}(?:[\x20./-]{1,2}[0-9]{2,6}){1,4}(?![0-9])",
    "number": r"(?<![0-9A-Za-z])[0-9]{2,4}(?:[\x20./-][0-9]{2,6}){1,5}(?![0-9A-Za-z])",
    "account": r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,4})?(?![A-Za-z0-9])",
}
ORDER = [*BASE, *MORE]
_HINTS = r"(?i)mail|phone|tel|fon|call|fax|mobil|contact|card|karte|visa|iban|konto|account|ip\b|address|adress|ssn"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of up to 19 digits passes the Luhn sum."""
    places = F.split(F.reverse(F.left(digits, F.lit(19))), "")

    def add(total: Column, i: Column) -> Column:
        d = F.element_at(places, i).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), F.size(places)), F.lit(0), add)
    return F.when(F.length(digits) > 0, total % 10 == 0).otherwise(False)


def _octets(value: Column) -> Column:
    """Whether all parts are at most 255, however many zeros stand before them."""
    part = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    return F.forall(part, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(999)) <= 255))


def base_spans(text: Column) -> Column:
    """The four base kinds; matches that fail their test are dropped."""
    email = S.find(text, "email", _EMAIL, text.contains("@"))
    ip = F.filter(S.find(text, "ip", _IP), lambda s: _octets(s["value"]))
    n = lambda s: F.length(_digits(s["value"]))
    card = F.filter(
        S.find(text, "card", _CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}")),
        lambda s: n(s).between(13, 19) & luhn(_digits(s["value"])),
    )
    phone = F.filter(S.find(text, "phone", _PHONE, text.contains("+")), lambda s: n(s).between(9, 15))
    return F.concat(email, ip, card, phone)


def more_spans(text: Column) -> Column:
    """Loose candidates; those with digits are only looked for where digits are."""
    digits = text.rlike("[0-9]")
    hints = {kind: digits for kind in MORE} | {"email_spelled": text.rlike(r"(?i)@|\bat\b|\(at|\[at")}
    return F.concat(*[S.find(text, kind, pattern, hints[kind] & text.rlike(pattern)) for kind, pattern in MORE.items()])


FEATURES = [
    "n_chars", "n_digits", "digit_share", "letter_share", "n_groups", "longest_group", "n_dots", "n_blanks",
    "n_dashes", "has_at", "luhn", "octets", "letter_before", "digit_before", "letter_after", "digit_after", "hint",
]


def features(df: DataFrame) -> DataFrame:
    """Add the features of ``value``, ``before`` and ``after``."""
    value, digits = F.col("value"), _digits(F.col("value"))
    size = F.greatest(F.length(value), F.lit(1))

    def count(pattern: str) -> Column:
        return F.length(F.regexp_replace(value, f"[^{pattern}]", ""))

    groups = F.filter(F.split(value, "[^0-9]+"), lambda g: g != "")
    columns = {
        "n_chars": F.length(value),
        "n_digits": F.length(digits),
        "digit_share": F.length(digits) / size,
        "letter_share": count("A-Za-z") / size,
        "n_groups": F.size(groups),
        "longest_group": F.coalesce(F.array_max(F.transform(groups, lambda g: F.length(g))), F.lit(0)),
        "n_dots": count("."),
        "n_blanks": count(r"\x20"),
        "n_dashes": count("-"),
        "has_at": value.contains("@"),
        "luhn": F.length(digits).between(13, 19) & luhn(digits),
        "octets": value.rlike(r"^[0-9]+(?:\.[0-9]+){3}$") & _octets(value),
        "letter_before": F.col("before").rlike("[A-Za-z]$"),
        "digit_before": F.col("before").rlike(r"[0-9][\x20.+-]?$"),
        "letter_after": F.col("after").rlike("^[A-Za-z]"),
        "digit_after": F.col("after").rlike(r"^[\x20.-]?[0-9]"),
        "hint": F.col("before").rlike(_HINTS),
    }
    return df.withColumns({name: columns[name].cast("double") for name in FEATURES})


def plausible() -> Column:
    """Whether a candidate may be personal data in a form that the strict patterns do not know."""
    by_form = F.col("kind").isin("email_spelled", "ip_spelled", "account")
    phone = (F.col("kind") == "phone_spelled") & F.col("n_digits").between(9, 15)
    return (F.col("luhn") == 1) | by_form | phone


@dataclass
class PiiModel:
    """Trees, the calibration of their score, and the least probability that selects."""

    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    threshold: float

    def select(self, candidates: DataFrame) -> DataFrame:
        """Candidates with features that the model selects, with their ``prob``."""
        if self.trees is None:
            return candidates.withColumn("prob", F.lit(0.0)).where(F.lit(False))
        scored = self.trees.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(candidates))
        scored = scored.withColumn("score", vector_to_array("probability")[1])
        calibrated = self.calibration.transform(scored).withColumnRenamed("calibrated", "prob")
        kept = [c for c in candidates.columns if c not in FEATURES]
        return calibrated.select(*kept, "prob").where(F.col("prob") >= self.threshold)


def fit(candidates: DataFrame, sample: int = 20_000, threshold: float = 0.9) -> PiiModel:
    """Learn from at most ``sample`` candidates, those with the smallest hashes; every fourth calibrates.

    ``candidates`` has ``confirmed`` (0/1), the features and ``_hash``. Those that
    are not confirmed but plausible teach nothing. With one class only there is
    nothing to learn, and the model selects nothing.
    """
    rows = candidates.where((F.col("confirmed") == 1) | ~plausible()).orderBy("_hash", *FEATURES).limit(sample).select("_hash", F.col("confirmed").cast("double").alias("label"), *FEATURES)
    rows = materialize(rows, "pii-sample")
    split = F.pmod(F.col("_hash"), F.lit(4)) == 0
    seen = {(r["part"], r["label"]) for r in rows.select(split.alias("part"), "label").distinct().collect()}
    if len(seen) < 4:
        return PiiModel(None, None, threshold)
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    rows = assembler.transform(rows).select("features", "label", split.alias("part"))
    trees = GBTClassifier(maxIter=8, maxDepth=4, stepSize=0.3, seed=7).fit(rows.where(~F.col("part")).coalesce(4))
    apart = trees.transform(rows.where("part")).select(vector_to_array("probability")[1].alias("score"), "label")
    calibration = IsotonicRegression(featuresCol="score", labelCol="label", predictionCol="calibrated").fit(apart.coalesce(1))
    return PiiModel(trees, calibration, threshold)


def _overlaps(spans: Column, s: Column) -> Column:
    return F.exists(spans, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", sample: int = 20_000, threshold: float = 0.9, keep: list[str] = ()) -> DataFrame:
    """``key, *keep, spans``: personal data in every text, with kind, place, value and probability.

    Base spans have probability 1. Of the other candidates those are added that
    the model selects and that touch neither a base span nor a likelier added
    one. Null text has none. Rows with equal keys are separate documents; an
    empty table gives an empty result. ``keep`` names columns to carry along.
    """
    carried = [F.col(c).alias(f"_c{i}") for i, c in enumerate(keep)]
    rows = df.select(F.col(key).alias("_key"), *carried, S.plain(F.col(text)).alias("_text"))
    rows = rows.withColumn("_base", base_spans(F.col("_text"))).withColumn("_more", more_spans(F.col("_text"))).drop("_text")
    rows = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "pii")
    full = rows.where(F.size("_base") + F.size("_more") > 0)
    confirmed = lambda s: _overlaps(F.col("_base"), s)
    tagged = F.transform(
        F.concat("_base", "_more"), lambda s: F.struct(s.alias("s"), confirmed(s).cast("int").alias("confirmed"))
    )
    each = full.select("_row", F.explode(tagged).alias("t")).select("_row", "t.s.*", "t.confirmed")
    each = features(each).withColumn("_hash", F.xxhash64("value", "before", "after"))
    each = materialize(each, "pii-candidates")
    model = fit(each, sample, threshold)
    added = model.select(each.where(F.col("kind").isin(list(MORE)) & (F.col("confirmed") == 0)))
    fields = ["kind", "start", "end", "value", "prob"]
    per_row = added.groupBy("_row").agg(F.collect_list(F.struct(*fields)).alias("_added"))
    kind = "array<struct<kind:string,start:bigint,end:bigint,value:string,prob:double>>"

    def best(spans: Column) -> Column:
        def better(a: Column, b: Column) -> Column:
            """Whether b is to be preferred to a: likelier, then longer, then further left, then by kind."""
            size = lambda s: s["end"] - s["start"]
            mine = F.struct(a["prob"], size(a), -a["start"], a["kind"])
            other = F.struct(b["prob"], size(b), -b["start"], b["kind"])
            return (b["start"] < a["end"]) & (a["start"] < b["end"]) & (other > mine)

        return F.filter(spans, lambda a: ~F.exists(spans, lambda b: better(a, b)))

    certain = F.transform("_base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.lit(1.0).alias("prob")))
    columns = ["_key", *[f"_c{i}" for i in range(len(keep))]]
    some = full.join(per_row, "_row", "left").select(
        *columns, F.concat(certain, F.coalesce(best(F.col("_added")), F.array().cast(kind))).alias("spans")
    )
    none = rows.where(F.size("_base") + F.size("_more") == 0).select(*columns, F.array().cast(kind).alias("spans"))
    named = [F.col("_key").alias(key), *[F.col(f"_c{i}").alias(c) for i, c in enumerate(keep)]]
    return some.unionByName(none).select(*named, "spans")


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    seed = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).cast("bigint").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        new = F.concat(acc["parts"], F.array(gap, F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))))
        inside = s["start"] < acc["at"]
        return F.struct(
            F.when(inside, acc["parts"]).otherwise(new).alias("parts"),
            F.greatest(acc["at"], s["end"]).alias("at"),
        )

    def finish(acc: Column) -> Column:
        rest = F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))
        return F.concat(F.array_join(acc["parts"], ""), rest)

    return F.when(F.size(spans) > 0, F.aggregate(ordered, seed, step, finish)).otherwise(text)


def digest(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, digest and list of the spans of every row."""
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"].isin(BASE))
    return scanned.select(
        key,
        *[S.of_kind(base, kind).alias(f"n_{kind}") for kind in BASE],
        F.sha2(S.listed(base, ORDER, by_kind=True), 256).alias("base_sha256"),
        S.listed(spans, ORDER, by_kind=True).alias("spans"),
        (F.size(spans) - F.size(base)).cast("bigint").alias("n_added"),
    )
