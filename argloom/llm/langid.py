"""Language identification in two steps: the family, then the language within it.

Linear support vector machines over hashed character n-grams. The first set
separates each family of languages from the others. Within a family there is one
machine for every pair of its languages, and the language with the most votes
wins. Training takes a bounded sample of labelled rows; prediction reads every
text whole, and sums weights over its n-grams, so that a text is never held as a
feature vector.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from argloom.llm.words import buffers, code_points, mix, row_groups, sums
from argloom.session import materialize

UNKNOWN = "und"
BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
BLOCK = 1 << 18
_BUCKET, _SHARE = np.dtype(">u2"), np.dtype(">f4")
# ISO 639 codes by family. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "af", "sv", "da", "no", "nb", "nn", "is", "fo", "fy", "lb", "yi"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "mk", "bg"],
    "baltic": ["lt", "lv"],
    "uralic": ["fi", "et", "hu"],
    "celtic": ["ga", "gd", "cy", "br"],
    "turkic": ["tr", "az", "kk", "ky", "uz", "tk", "tt"],
    "indo-aryan": ["hi", "ur", "bn", "pa", "gu", "mr", "ne", "si"],
    "iranian": ["fa", "ps", "ku", "tg"],
    "dravidian": ["ta", "te", "kn", "ml"],
    "semitic": ["ar", "he", "am", "mt"],
    "austronesian": ["id", "ms", "jv", "tl", "mg"],
}


def family_of(lang: str) -> str:
    return next((family for family, langs in FAMILIES.items() if lang in langs), lang)


def _kinds() -> np.ndarray:
    """1 for code points that are letters."""
    import regex

    text = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "\0" for c in range(0x110000))
    out = np.zeros(0x110000, dtype=bool)
    for run in regex.finditer(r"\p{L}+", text):
        out[run.start() : run.end()] = True
    return out


class Features:
    """N-grams of letters and the word ends around them, hashed into buckets."""

    _letters: np.ndarray | None = None

    @classmethod
    def letters(cls) -> np.ndarray:
        if cls._letters is None:
            cls._letters = _kinds()
        return cls._letters

    @classmethod
    def of(cls, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Buckets of the n-grams, whether each counts, each row's range, and letters per row.

        All runs of other characters look like one blank: numbers, signs and
        layout say nothing about the language. Case is folded for A-Z and the
        accented letters of Latin-1.
        """
        points, at = code_points(data, bounds)
        is_letter = cls.letters()[points]
        folded = points.copy()
        upper = ((points >= 65) & (points <= 90)) | ((points >= 0xC0) & (points <= 0xDE) & (points != 0xD7))
        folded[upper] += 32
        folded[~is_letter] = 32
        n_letters = np.concatenate([[0], np.cumsum(is_letter)])
        p = folded.astype(np.uint64)
        first = np.zeros(len(p), dtype=np.int64)
        if len(p):
            first = np.arange(len(p)) - np.repeat(at[:-1], np.diff(at))
        columns, counts = [], []
        key = np.zeros(len(p), dtype=np.uint64)
        any_letter = np.zeros(len(p), dtype=bool)
        for k in range(1, max(ORDERS) + 1):
            back = k - 1
            shifted = np.full(len(p), 32, dtype=np.uint64)
            shifted_letter = np.zeros(len(p), dtype=bool)
            shifted[back:] = p[: len(p) - back]
            shifted_letter[back:] = is_letter[: len(p) - back]
            shifted[first < back] = 32
            shifted_letter[first < back] = False
            key = (key << np.uint64(21)) | shifted
            any_letter |= shifted_letter
            columns.append((mix(key + np.uint64(k)) & np.uint64(BUCKETS - 1)).astype(np.int64))
            counts.append(any_letter.copy())
        return np.stack(columns, axis=1), np.stack(counts, axis=1), at, np.diff(n_letters[at])


def _wide(x: np.ndarray, columns: int = 1024) -> Iterator[np.ndarray]:
    """The columns of ``x`` as doubles, a few at a time: the sample is never held a second time."""
    for at in range(0, x.shape[1], columns):
        yield x[:, at : at + columns].astype(np.float64)


def _train_svm(x: np.ndarray, y: np.ndarray, steps: int = 300, ridge: float = 1e-4) -> np.ndarray:
    """Weights of a linear support vector machine (squared hinge) with a bias as last entry.

    Gradient descent with momentum over the whole sample, in terms of products
    between its rows: weights are a sum of rows, and only its factors change.
    The result does not depend on the order of rows. Classes count alike,
    however many rows each has.
    """
    products = np.ones((len(y), len(y)))  # the 1 is the bias, a feature that all rows share
    for part in _wide(x):
        products += part @ part.T
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    factors = np.zeros(len(y))
    speed = np.zeros(len(y))
    step = 1.0 / (2 * float((weight * np.diag(products)).sum()) + ridge)
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (products @ factors))
        speed = 0.9 * speed - step * (ridge * factors - 2 * weight * y * slack)
        factors = factors + speed
    return np.concatenate([*[part.T @ factors for part in _wide(x)], [factors.sum()]])


@dataclass
class LanguageModel:
    """Families, their machines, and for each family its languages and pair machines.

    ``weights`` has one column per machine: families first, then all pairs.
    """

    families: list[str]
    languages: dict[str, list[str]]
    pairs: list[tuple[str, str, str]]
    weights: np.ndarray
    bias: np.ndarray

    def margins(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Margin of every machine for every text, and its number of letters."""
        buckets, counted, at, letters = Features.of(data, bounds)
        rows = len(bounds) - 1
        total = np.zeros((rows, self.weights.shape[1]))
        norm = np.zeros(rows)
        for k in range(buckets.shape[1]):
            keep = counted[:, k]
            seen = np.concatenate([[0], np.cumsum(keep)])[at]
            own = buckets[keep, k]
            for m in range(self.weights.shape[1]):
                total[:, m] += sums(self.weights[:, m][own], seen)
            norm += np.diff(seen)
        return total / np.maximum(norm, 1)[:, None] + self.bias, letters

    def predict(self, data: np.ndarray, bounds: np.ndarray) -> tuple[list[str], np.ndarray]:
        rows = len(bounds) - 1
        if not self.families:
            return [UNKNOWN] * rows, np.zeros(rows)
        margins, letters = self.margins(data, bounds)
        n = len(self.families)
        family = margins[:, :n].argmax(axis=1) if n > 1 else np.zeros(rows, dtype=int)
        sure = 1 / (1 + np.exp(-2 * margins[:, :n].max(axis=1))) if n > 1 else np.ones(rows)
        out = np.empty(rows, dtype=object)
        score = np.array(sure)
        for number, name in enumerate(self.families):
            own = np.flatnonzero(family == number)
            langs = self.languages[name]
            votes = np.zeros((len(own), len(langs)))
            strength = np.zeros((len(own), len(langs)))
            for m, (of, a, b) in enumerate(self.pairs):
                if of != name:
                    continue
                margin = margins[own, n + m]
                won = np.where(margin > 0, langs.index(a), langs.index(b))
                votes[np.arange(len(own)), won] += 1
                strength[:, langs.index(a)] += np.clip(margin, -1, 1)
                strength[:, langs.index(b)] -= np.clip(margin, -1, 1)
            # Ties between votes go to the larger sum of margins.
            best = (votes + strength / (4 * len(langs))).argmax(axis=1) if len(langs) > 1 else np.zeros(len(own), int)
            out[own] = np.array(langs, dtype=object)[best]
            if len(langs) > 1:
                mean = strength[np.arange(len(own)), best] / (len(langs) - 1)
                score[own] *= 1 / (1 + np.exp(-2 * mean))
        none = letters == 0
        out[none] = UNKNOWN
        score[none] = 0.0
        return out.tolist(), np.clip(score, 0, 1)


def _shares(df: DataFrame) -> DataFrame:
    """``lang, buckets, shares`` of each row of ``lang, text``: a text's n-grams by bucket.

    Both are arrays of numbers as bytes, six for each bucket, that sort as the numbers do.
    """

    def run(batches):
        for batch in batches:
            data, bounds = buffers(batch.column(1))
            found, shares = [], []
            for row in range(batch.num_rows):
                own = data[bounds[row] : bounds[row + 1]]
                buckets, counted, _, _ = Features.of(own, np.array([0, len(own)]))
                own, n = np.unique(buckets[counted], return_counts=True)
                found.append(own.astype(_BUCKET).tobytes())
                shares.append((n / max(1, n.sum())).astype(_SHARE).tobytes())
            columns = [batch.column(0), pa.array(found, pa.binary()), pa.array(shares, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "buckets", "shares"])

    return df.select("lang", "text").mapInArrow(run, "lang string, buckets binary, shares binary")


def fit(
    df: DataFrame, lang: str = "lang", text: str = "text", sample_per_language: int = 150, sample_rows: int = 2400
) -> LanguageModel:
    """Train on at most ``sample_per_language`` rows a language and about ``sample_rows`` in all.

    The sample takes the rows whose whole texts have the least hashes. Rows
    without a language or without text are passed over. Each bucket is scaled by
    the square root of its mean share, which keeps common n-grams from drowning
    the others; the scale is folded into the weights.
    """
    rows = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")
    )
    rows = rows.withColumn("hash", F.xxhash64("text", F.lit(17)))
    # The least hash of each of many slots, then the least of those: nothing is sorted or collected whole.
    slots = rows.groupBy("lang", F.pmod("hash", F.lit(1024)).alias("slot")).agg(F.min("hash").alias("hash"))
    per_language = slots.groupBy("lang").agg(F.array_sort(F.collect_list("hash")).alias("hashes"))
    per_language = materialize(per_language, "language-sample")
    most = max(1, min(sample_per_language, sample_rows // max(1, per_language.count())))
    chosen = per_language.select("lang", F.explode(F.slice("hashes", 1, most)).alias("hash"))
    found = rows.join(F.broadcast(chosen), ["lang", "hash"]).dropDuplicates(["lang", "hash"])
    sample = sorted((r["lang"], r["buckets"], r["shares"]) for r in _shares(found).collect())
    own = np.array([row[0] for row in sample])
    langs = sorted(set(own.tolist()))
    families = sorted({family_of(lang) for lang in langs})
    languages = {f: [lang for lang in langs if family_of(lang) == f] for f in families}
    pairs = [(f, a, b) for f in families for a, b in combinations(languages[f], 2)]
    if not sample:
        return LanguageModel([], {}, [], np.zeros((BUCKETS, 0)), np.zeros(0))
    x = np.zeros((len(sample), BUCKETS), dtype=np.float32)
    for row, (_, buckets, shares) in enumerate(sample):
        x[row, np.frombuffer(buckets, _BUCKET).astype(np.int64)] = np.frombuffer(shares, _SHARE)
    sample.clear()
    scale = 1 / np.sqrt(x.mean(axis=0) + 1e-6)
    x *= scale
    factor = 1.0 / (float(np.sqrt([(row**2).sum() for row in x]).mean()) or 1.0)
    x *= factor
    family = np.array([family_of(lang) for lang in own])
    machines = [np.zeros(BUCKETS + 1)]
    if len(families) > 1:
        machines = [_train_svm(x, np.where(family == f, 1, -1).astype(np.float32)) for f in families]
    for _, a, b in pairs:
        both = (own == a) | (own == b)
        machines.append(_train_svm(x[both], np.where(own[both] == a, 1, -1).astype(np.float32)))
    w = np.stack(machines, axis=1).astype(np.float64)
    return LanguageModel(families, languages, pairs, w[:-1] * (scale * factor)[:, None], w[-1])


def held_out(key: Column, folds: int = 3) -> Column:
    """Whether a key is in the fold that training never sees; a null key counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == 1


def predict(df: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text", keep: list[str] = ()) -> DataFrame:
    """``key, *keep, lang_pred, score`` of every row: the language, and how sure it is (0 to 1).

    ``und`` with score 0 where the text is null or has no letter. Rows with
    equal keys are predicted one by one; an empty table gives an empty result.
    Only the text is an input of the prediction.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    carried = [f"_c{i}" for i in range(len(keep))]

    def run(batches):
        model = shared.value
        for batch in batches:
            data, bounds = buffers(batch.column(batch.num_columns - 1))
            langs, scores = [], [np.zeros(0)]
            for a, z in row_groups(bounds, BLOCK):
                own = bounds[a : z + 1]
                found, score = model.predict(data[own[0] : own[-1]], own - own[0])
                langs += found
                scores.append(score)
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            columns += [pa.array(langs, pa.string()), pa.array(np.concatenate(scores))]
            yield pa.RecordBatch.from_arrays(columns, names=["_key", *carried, "lang_pred", "score"])

    fields = [StructField("_key", df.schema[key].dataType)]
    fields += [StructField(name, df.schema[c].dataType) for name, c in zip(carried, keep)]
    schema = StructType([*fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    source = df.select(
        F.col(key).alias("_key"), *[F.col(c).alias(name) for name, c in zip(carried, keep)], F.col(text).cast("string").alias("_text")
    )
    out = source.mapInArrow(run, schema)
    named = [F.col(name).alias(c) for name, c in zip(carried, keep)]
    return out.select(F.col("_key").alias(key), *named, "lang_pred", "score")


def language_id(df: DataFrame, key: str = "doc_id", lang: str = "lang", text: str = "text", keep: list[str] = ()) -> DataFrame:
    """``key, held_out, lang_pred, score``: trained on the rows that are not held out."""
    model = fit(df.where(~held_out(F.col(key))), lang, text)
    return predict(df, model, key, text, keep).withColumn("held_out", held_out(F.col(key)))
