"""Quality rules: counts of a text, and its perplexity under its language's model.

The model is an interpolated modified Kneser-Ney model of characters, one per
language. Spark counts the longest n-grams over all texts; the shorter ones are
continuation counts of the longer. Probabilities are worked out with joins and
windows, and end as arrays sorted by key. Verdicts come from models of the
texts that are not suspicious (:func:`sound`), so that frequent junk does not
look likely. The key of an n-gram is a bijection of its 64 bits that differs by
language, so within a language a miss is always a miss; n-grams of two languages
meet with a chance of about 2**-64. Arrays are cut by ranges of keys into files
of bounded size in the shared folder, which tasks map into memory.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from argloom.llm.lmtrie import _read, _write
from argloom.llm.words import (
    buffers,
    code_points,
    distinct,
    hash_runs,
    mix,
    per_row,
    row_groups,
    sums,
    windows,
    words,
)
from argloom.session import materialize, scratch_path

SHARD = 1 << 22  # about so many entries, of all tables together, make one file (12 bytes each)
ORDER = 4  # characters of 16 bits, so that the longest n-gram is one whole number of 64 bits
START = 0xFFFF
BLOCK = 1 << 18
# Distinct n-grams that a task holds before it hands them on.
HELD = 1 << 20
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _folded(points: np.ndarray) -> np.ndarray:
    """Characters in 16 bits; those above share the private use area."""
    small = np.where(points < 0xFFFF, points, 0xE000 + points % 6400)
    return small.astype(np.uint64)


def _grams(points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The n-gram that ends at each character; before a text stand start marks."""
    p = _folded(points)
    out = p.copy()
    first = np.repeat(bounds[:-1], np.diff(bounds))
    place = np.arange(len(p)) - first
    for back in range(1, ORDER):
        before = np.full(len(p), START, dtype=np.uint64)
        before[back:] = p[:-back] if len(p) > back else p[:0]
        before[place < back] = START
        out |= before << np.uint64(16 * back)
    return out


def _language_seed(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


def _keys(grams: np.ndarray, seed: np.uint64) -> np.ndarray:
    return mix(mix(grams) ^ seed)


def _shards(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(keys), np.int32)


def _by_language(batch: pa.RecordBatch) -> list[tuple[str, np.ndarray]]:
    langs = batch.column("lang").to_pandas().fillna("").to_numpy()
    return [(str(lang), np.flatnonzero(langs == lang)) for lang in sorted(set(langs))]


def passes(n_words, n_repeat_words):
    """Whether texts pass the counts; for arrays and for columns."""
    return (n_words >= 10) & (100 * n_repeat_words <= 20 * n_words)


def sound(n_words, n_repeat_words, n_symbols):
    """Whether texts pass the counts and have at most one symbol in 20 words; for arrays and for columns."""
    return passes(n_words, n_repeat_words) & (20 * n_symbols <= n_words)


def count_grams(df: DataFrame, trusted: bool = False) -> DataFrame:
    """``lang, gram, n, n_sound`` over the texts of a table with ``lang`` and ``text``.

    ``trusted`` leaves out texts that fail the counts, and ``n_sound`` are the
    n-grams of :func:`sound` texts among the others; without it all texts count
    and are taken for sound.
    """

    def run(batches):
        held: dict[str, list] = {}
        size = 0

        def merged(lang):
            keys, counts = (np.concatenate(x) for x in zip(*held[lang]))
            order = np.argsort(keys)
            keys, counts = keys[order], counts[order]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
            return keys[first], np.add.reduceat(counts, first, axis=0) if len(first) else counts

        def out():
            for lang in held:
                keys, counts = merged(lang)
                for at in range(0, len(keys), 1 << 16):
                    part = slice(at, at + (1 << 16))
                    columns = [
                        pa.array([lang] * len(keys[part]), pa.string()),
                        pa.array(keys[part].view(np.int64)),
                        pa.array(np.ascontiguousarray(counts[part, 0])),
                        pa.array(np.ascontiguousarray(counts[part, 1])),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "gram", "n", "n_sound"])
            held.clear()

        for batch in batches:
            for lang, rows in _by_language(batch):
                data, bounds = buffers(batch.column("text").take(pa.array(rows)))
                for a, z in row_groups(bounds, BLOCK):
                    own = bounds[a : z + 1]
                    piece, own = data[own[0] : own[-1]], own - own[0]
                    points, at = code_points(piece, own)
                    grams, good, usable = _grams(points, at), np.ones(z - a, bool), np.ones(z - a, bool)
                    if trusted:
                        counts = text_counts(piece, own)
                        usable = passes(counts["n_words"], counts["n_repeat_words"])
                        good = sound(counts["n_words"], counts["n_repeat_words"], counts["n_symbols"])
                    for some, weights in ((good, (1, 1)), (usable & ~good, (1, 0))):
                        part = np.sort(grams[np.repeat(some, np.diff(at))])
                        if not len(part):
                            continue
                        first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
                        n = np.diff(np.append(first, len(part)))
                        held.setdefault(lang, []).append((part[first], np.outer(n, weights)))
                        size += len(first)
                    if size > HELD:
                        held.update({k: [merged(k)] for k in list(held)})
                        size = sum(len(v[0][0]) for v in held.values())
                        if size > HELD // 2:
                            yield from out()
                            size = 0
        yield from out()

    source = df.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counted = source.mapInArrow(run, "lang string, gram bigint, n bigint, n_sound bigint")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("n_sound").alias("n_sound"))


def _discount(level: DataFrame) -> DataFrame:
    """The three discounts of each language, from how many n-grams occur once to four times."""
    n = [F.sum((F.col("n") == k).cast("bigint")).alias(f"_n{k}") for k in range(1, 5)]
    found = level.groupBy("lang").agg(*n, F.count("*").alias("_types"))
    y = F.coalesce(F.try_divide(F.col("_n1"), F.col("_n1") + 2 * F.col("_n2")), F.lit(0.0))
    out = found
    for k in (1, 2, 3):
        value = F.lit(k) - (k + 1) * y * F.col(f"_n{k + 1}") / F.col(f"_n{k}")
        usual = F.when((F.col(f"_n{k}") > 0) & (F.col(f"_n{k + 1}") > 0), value)
        out = out.withColumn(f"_d{k}", F.greatest(F.lit(0.1), F.least(F.coalesce(usual, F.lit(k * 0.5)), F.lit(float(k)))))
    return out.select("lang", "_d1", "_d2", "_d3", "_types")


def _smooth(level: DataFrame, lower: DataFrame | None) -> DataFrame:
    """``lang, gram, n, p, context, gamma``: interpolated probabilities of one order.

    Contexts are summed up by (language, context) before anything is joined by
    language alone, so that no step deals its rows out over a few languages only.
    """
    context = F.lit(0).cast("bigint") if lower is None else F.shiftrightunsigned("gram", 16)
    level = level.withColumn("context", context)
    kinds = [F.sum((F.col("n") == k).cast("bigint")).alias(f"_n{k}") for k in (1, 2)]
    kinds.append(F.sum((F.col("n") > 2).cast("bigint")).alias("_n3"))
    contexts = level.groupBy("lang", "context").agg(F.sum("n").alias("_total"), *kinds)
    held_back = sum(F.col(f"_d{k}") * F.col(f"_n{k}") for k in (1, 2, 3))
    contexts = contexts.join(_discount(level), "lang").withColumn("gamma", held_back / F.col("_total"))
    rows = level.join(contexts, ["lang", "context"])
    d = F.when(F.col("n") == 1, F.col("_d1")).when(F.col("n") == 2, F.col("_d2")).otherwise(F.col("_d3"))
    own = (F.col("n") - d) / F.col("_total")
    out = ["lang", "gram", "n", "context", "gamma"]
    if lower is None:
        return rows.select(*out, (own + F.col("gamma") / (F.col("_types") + 1)).alias("p"))
    shorter = lower.select("lang", F.col("gram").alias("tail"), F.col("p").alias("lower"))
    return rows.join(shorter, ["lang", "tail"]).select(*out, (own + F.col("gamma") * F.col("lower")).alias("p"))


def _tail(k: int) -> Column:
    """The n-gram without its first character."""
    return F.col("gram").bitwiseAND(F.lit((1 << 16 * (k - 1)) - 1)) if k > 1 else F.lit(0).cast("bigint")


@dataclass
class LanguageModels:
    """Per order, log probabilities (g0 to g4) and log weights of contexts (c1 to c4), in files of sorted keys.

    A file has all entries whose keys start with the same ``bits`` bits;
    ``paths`` has the files that are not empty.
    """

    paths: dict[int, str]
    bits: int

    @property
    def grams(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Keys and log probabilities of each order, all files together."""
        files = [_read(self.paths[k]) for k in sorted(self.paths)]
        empty = [np.zeros(0, np.uint64)], [np.zeros(0, np.float32)]
        return [tuple(np.concatenate(e + [f[f"g{k}{part}"] for f in files]) for part, e in zip("kv", empty)) for k in range(ORDER + 1)]

    def _find(self, name: str, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hit, out = np.zeros(len(keys), bool), np.zeros(len(keys))
        order = np.argsort(keys)
        shards = _shards(keys[order], self.bits)
        for rows in np.split(order, np.flatnonzero(np.diff(shards)) + 1) if len(order) else []:
            path = self.paths.get(int(_shards(keys[rows[:1]], self.bits)[0]))
            table = _read(path) if path else {}
            own = table.get(f"{name}k", ())
            if len(own):
                at = np.minimum(np.searchsorted(own, keys[rows]), len(own) - 1)
                hit[rows] = own[at] == keys[rows]
                out[rows] = np.where(hit[rows], table[f"{name}v"][at], 0.0)
        return hit, out

    def log_probs(self, grams: np.ndarray, seed: np.uint64) -> np.ndarray:
        """Natural log probability of the last character of each n-gram."""
        own, _, inverse = distinct(grams)
        out = np.zeros(len(own))
        left = np.arange(len(own))
        for k in range(ORDER, -1, -1):
            part = own[left] & np.uint64((1 << 16 * k) - 1)
            hit, value = self._find(f"g{k}", _keys(part, seed))
            out[left] += np.where(hit, value, 0.0)
            left = left[~hit]
            if k:
                part = (own[left] & np.uint64((1 << 16 * k) - 1)) >> np.uint64(16)
                out[left] += self._find(f"c{k}", _keys(part, seed))[1]
        out[left] -= np.log(65536.0)  # a language without a model
        return out[inverse]


def fit_models(df: DataFrame, lang: str = "lang", text: str = "text", trusted: bool = False) -> LanguageModels:
    """Models of all languages of a table, counted over all its texts.

    With ``trusted``, only over the :func:`sound` ones; in a language where these
    have less than half the characters of the texts that pass the counts (source
    code, say), symbols are nothing suspicious and all that pass are taken.

    A null language is a language of its own; null and empty texts add nothing;
    an empty table gives empty models. Only the two columns are read.
    """
    source = df.select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counted = materialize(count_grams(source, trusted), "grams")
    clear = counted.groupBy("lang").agg((2 * F.sum("n_sound") >= F.sum("n")).alias("_clear"))
    n = F.when(F.col("_clear"), F.col("n_sound")).otherwise(F.col("n"))
    levels = {ORDER: counted.join(F.broadcast(clear), "lang").select("lang", "gram", n.alias("n")).where("n > 0")}
    for k in range(ORDER, 1, -1):
        shorter = levels[k].select("lang", _tail(k).alias("gram"))
        levels[k - 1] = materialize(shorter.groupBy("lang", "gram").agg(F.count("*").alias("n")), f"grams{k - 1}")
    solved, lower = {}, None
    for k in range(1, ORDER + 1):
        level = levels[k].withColumn("tail", _tail(k))
        solved[k] = lower = materialize(_smooth(level, lower), f"probs{k}")
    unseen = levels[1].groupBy("lang").agg(F.count("*").alias("n")).select(
        "lang", F.lit(0).cast("bigint").alias("gram"), "n", (1 / (F.col("n") + 1)).alias("p")
    )
    tables = [(f"g{k}", (unseen if k == 0 else solved[k]).select("lang", "gram", F.ln("p").alias("value"))) for k in range(ORDER + 1)]
    tables += [
        (f"c{k}", solved[k].groupBy("lang", F.col("context").alias("gram")).agg(F.ln(F.max("gamma")).alias("value")))
        for k in range(1, ORDER + 1)
    ]

    names = [name for name, _ in tables]
    bits = (2 * sum(solved[k].count() for k in solved) // SHARD).bit_length()  # contexts are no more than n-grams
    root = scratch_path(df.sparkSession, "models")

    def key(batches):
        for batch in batches:
            langs = batch.column("lang").to_pandas().to_numpy()
            grams = batch.column("gram").to_numpy().view(np.uint64)
            out = np.zeros(len(grams), dtype=np.uint64)
            for name in set(langs):
                rows = langs == name
                out[rows] = _keys(grams[rows], _language_seed(name))
            columns = [pa.array(_shards(out, bits)), batch.column("name"), pa.array(out.view(np.int64)), batch.column("value")]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "name", "key", "value"])

    def write(batches):
        held: dict[int, list] = {}
        for batch in batches:
            shard, *rest = (c.to_numpy() for c in batch.columns)
            for k in np.unique(shard):
                held.setdefault(int(k), []).append([c[shard == k] for c in rest])
        for k, parts in held.items():
            name, keys, values = (np.concatenate(x) for x in zip(*parts))
            keys, arrays = keys.view(np.uint64), {}
            order = np.lexsort((keys, name))
            cuts = np.searchsorted(name[order], np.arange(len(names) + 1))
            for title, a, z in zip(names, cuts, cuts[1:]):
                arrays[f"{title}k"], arrays[f"{title}v"] = keys[order[a:z]], values[order[a:z]]
            _write(f"{root}/{k}", arrays)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32())], names=["shard"])

    rows = None
    for k, (_, table) in enumerate(tables):
        table = table.select(F.lit(k).alias("name"), "lang", "gram", F.col("value").cast("float").alias("value"))
        rows = table if rows is None else rows.unionByName(table)
    keyed = rows.mapInArrow(key, "shard int, name int, key bigint, value float")
    written = keyed.repartition(1 << bits, "shard").mapInArrow(write, "shard int").collect()  # one row a file
    return LanguageModels({r["shard"]: f"{root}/{r['shard']}" for r in written}, bits)


def _repeats(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a key occurs twice or more in its row, and whether it is the first of its kind there."""
    _, first, inverse = distinct(keys ^ mix(rows.astype(np.uint64)))
    counts = np.bincount(inverse, minlength=len(first))
    once = np.zeros(len(keys), dtype=bool)
    once[first] = True
    return counts[inverse] > 1, once


def text_counts(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """Words, their characters, symbols, repeated lines and repeated words of every text."""
    found = words(data, bounds)
    lead = (data & 0xC0) != 0x80
    total = np.concatenate([[0], np.cumsum(lead)])
    chars = total[found.ends] - total[found.starts]
    lines = hash_runs(data, data != 0x0A, bounds, fold=False)
    has_word = np.searchsorted(found.starts, lines.ends) > np.searchsorted(found.starts, lines.starts)
    line_rows = lines.rows
    _, once = _repeats(lines.hashes[has_word], line_rows[has_word])
    dup_lines = np.bincount(line_rows[has_word][~once], minlength=len(bounds) - 1)
    keys, of_row = windows(found, 5)
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(of_row))
    again, _ = _repeats(keys, rows)
    first_word = (np.arange(len(keys)) - of_row[rows] + found.bounds[rows])[again]
    cover = np.zeros(len(found.hashes) + 6, dtype=np.int64)
    np.add.at(cover, first_word, 1)
    np.add.at(cover, first_word + 5, -1)
    covered = np.cumsum(cover)[: len(found.hashes)] > 0
    return {
        "n_words": np.diff(found.bounds),
        "word_chars": sums(chars, found.bounds),
        "n_symbols": per_row(_SYMBOL[data], bounds),
        "n_dup_lines": dup_lines,
        "n_repeat_words": per_row(covered, found.bounds),
    }


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measure(df: DataFrame, models: LanguageModels, key: str = "doc_id", lang: str = "lang", text: str = "text") -> DataFrame:
    """``key, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_chars, log_prob``.

    Null text counts as empty: all counts are 0 and so is ``log_prob``.
    """
    names = ["key", "lang", *COUNTS, "n_chars", "log_prob"]

    def run(batches):
        for batch in batches:
            data, bounds = buffers(batch.column("text"))
            counts = {name: np.zeros(batch.num_rows, np.int64) for name in COUNTS}
            for a, z in row_groups(bounds, BLOCK):
                own = bounds[a : z + 1]
                for name, values in text_counts(data[own[0] : own[-1]], own - own[0]).items():
                    counts[name][a:z] = values
            n_chars = np.zeros(batch.num_rows, np.int64)
            log_prob = np.zeros(batch.num_rows)
            for lang, rows in _by_language(batch):
                data, bounds = buffers(batch.column("text").take(pa.array(rows)))
                seed = _language_seed(lang)
                for a, z in row_groups(bounds, BLOCK):
                    own = bounds[a : z + 1]
                    points, at = code_points(data[own[0] : own[-1]], own - own[0])
                    n_chars[rows[a:z]] = np.diff(at)
                    log_prob[rows[a:z]] = sums(models.log_probs(_grams(points, at), seed), at)
            columns = [batch.column("key"), batch.column("lang"), *(pa.array(counts[n]) for n in COUNTS)]
            columns += [pa.array(n_chars), pa.array(log_prob)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = df.schema[key].dataType.simpleString()
    schema = f"key {kind}, lang string, " + ", ".join(f"{c} bigint" for c in [*COUNTS, "n_chars"]) + ", log_prob double"
    source = df.select(
        F.col(key).alias("key"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")
    )
    return source.mapInArrow(run, schema).withColumnRenamed("key", key)


def judge(measured: DataFrame, key: str = "doc_id", reach: float = 5.0, steady: int = 1000) -> DataFrame:
    """Add ``base_failed``, ``perplexity``, the language's ``low`` and ``high`` band and ``kept``.

    The band of a language runs ``reach`` quartile distances beyond the
    quartiles of the log perplexities of the documents that trusted models are
    fitted on; a language whose documents are all alike has a band of at least
    5 % about them. Below ``steady`` characters a mean over so few scatters more, and the
    band widens with one over the square root of the length. A document outside
    its band is rejected.
    """
    failed = ~passes(F.col("n_words"), F.col("n_repeat_words"))
    rows = measured.withColumn("base_failed", failed).withColumn(
        "_log", F.when(F.col("n_chars") > 0, -F.col("log_prob") / F.col("n_chars"))
    )
    good = sound(F.col("n_words"), F.col("n_repeat_words"), F.col("n_symbols"))

    def quartiles(value: Column) -> Column:
        return F.percentile_approx(value, F.array(F.lit(0.25), F.lit(0.75)), 10000)

    clear = 2 * F.sum(F.when(good, F.col("n_chars")).otherwise(0)) >= F.sum("n_chars")
    of_sound, of_all = quartiles(F.when(good, F.col("_log"))), quartiles(F.col("_log"))
    bands = rows.where(~F.col("base_failed")).groupBy("lang").agg(F.when(clear, of_sound).otherwise(of_all).alias("_q"))
    wide = F.greatest(reach * (F.col("_q")[1] - F.col("_q")[0]), F.lit(0.05))
    bands = bands.select(F.col("lang").alias("_lang"), "_q", wide.alias("_wide"))
    scatter = F.greatest(F.lit(1.0), F.sqrt(F.lit(float(steady)) / F.greatest("n_chars", F.lit(1))))
    joined = (
        rows.join(bands, F.col("lang").eqNullSafe(F.col("_lang")), "left")
        .withColumn("_low", F.col("_q")[0] - scatter * F.col("_wide"))
        .withColumn("_high", F.col("_q")[1] + scatter * F.col("_wide"))
    )
    inside = F.col("_log").between(F.col("_low"), F.col("_high"))
    return joined.select(
        key,
        *COUNTS,
        "base_failed",
        (~F.col("base_failed") & F.coalesce(inside, F.lit(True))).alias("kept"),
        F.exp("_log").alias("perplexity"),
        F.exp("_low").alias("low"),
        F.exp("_high").alias("high"),
    )


def quality_rules(df: DataFrame, key: str = "doc_id", lang: str = "lang", text: str = "text", reach: float = 5.0) -> DataFrame:
    """Counts, perplexity, band and verdict of every row, models and bands taken from the sound texts of the same table.

    Null or empty text has no words, fails the counts and is not kept. Null
    languages share one model. Rows with equal keys are judged one by one. An
    empty table gives an empty result. Other columns are not read.
    """
    models = fit_models(df, lang, text, trusted=True)
    return judge(materialize(measure(df, models, key, lang, text), "measured"), key, reach)
