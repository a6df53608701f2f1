"""The same queries as SQL for DuckDB, written independently of the operators.

Sentences are split here with windows over candidate pieces, pairs come from a
range self-join, scores from joins: other ways to the same rows.
"""

from __future__ import annotations

# The boundary patterns, without look-around.
WS = r"[\x09-\x0d\x1c-\x20\x{85}\p{Z}]+"
HTML = r"(?is)<!--.*?-->|<(script|style)\b.*?</(?:script|style)\s*>|<[^>]+>"
END = r"""([.!?]["'')\]}]*) """
INIT = r"(^|[^\p{L}\p{N}])\p{L}\.$"
NEXT_INIT = r"^[\p{L};:,.!?]"
NUM = r"(^| )-?[.,]?[0-9][0-9,.\-]*\.$"
NEXT_NUM = r"^[\p{Ll};:,.!?]"
DOTS = r"""\.\.["'')\]}]*$"""

CLEAN = (
    f"trim(regexp_replace(regexp_replace(replace(replace(%s, chr(1), ' '), chr(2), ' '), "
    f"'<[^>]+>', ' ', 'g'), '{WS}', ' ', 'g'), ' ')"
)


def tokens(text: str) -> str:
    return (
        f"list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), "
        "lambda w: w <> '')"
    )


def sentences(name: str, source: str, keys: str, col: str) -> str:
    """CTEs ending in ``name``: keys, sent_idx, text, start_index, end_index."""
    over = f"PARTITION BY {keys} ORDER BY k"
    return f"""
{name}_clean AS (SELECT {keys}, {CLEAN % col} AS clean FROM {source}),
{name}_list AS (SELECT {keys},
    string_split(regexp_replace(clean, '{END}', '\\1' || chr(1), 'g'), chr(1)) AS p
  FROM {name}_clean),
{name}_piece AS (SELECT * FROM (SELECT {keys}, unnest(p) AS t, generate_subscripts(p, 1) AS k
  FROM {name}_list) WHERE t <> ''),
{name}_next AS (SELECT *, lead(t) OVER ({over}) AS nx,
    coalesce(sum(length(t) + 1) OVER ({over}
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st
  FROM {name}_piece),
{name}_break AS (SELECT *, CASE WHEN nx IS NULL THEN 0
    WHEN regexp_matches(t, '{INIT}') AND regexp_matches(nx, '{NEXT_INIT}') THEN 0
    WHEN regexp_matches(t, '{NUM}') AND regexp_matches(nx, '{NEXT_NUM}') THEN 0
    WHEN regexp_matches(t, '{DOTS}') THEN 0 ELSE 1 END AS br
  FROM {name}_next),
{name}_group AS (SELECT *, coalesce(sum(br) OVER ({over}
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM {name}_break),
{name} AS (SELECT {keys}, g::INTEGER AS sent_idx, string_agg(t, ' ' ORDER BY k) AS text,
    min(st)::BIGINT AS start_index, max(st + length(t))::BIGINT AS end_index
  FROM {name}_group GROUP BY {keys}, g)"""


def tight_sentences(name: str, source: str, keys: str, clean: str) -> str:
    """The same with breaks before a bracket, ``*`` or ``@``; those carry chr(3) at the end of a piece."""
    over = f"PARTITION BY {keys} ORDER BY k"
    return f"""
{name}_list AS (SELECT {keys}, string_split(regexp_replace(regexp_replace({clean}, '{END}', '\\1' || chr(1), 'g'),
    '([.!?]["'')\\]}}]*)([(\\[{{*@])', '\\1' || chr(3) || chr(1) || '\\2', 'g'), chr(1)) AS p FROM {source}),
{name}_piece AS (SELECT {keys}, k, ends, rtrim(t, chr(3)) AS t FROM (SELECT *, ends_with(t, chr(3)) AS ends FROM
  (SELECT {keys}, unnest(p) AS t, generate_subscripts(p, 1) AS k FROM {name}_list)) WHERE t <> ''),
{name}_next AS (SELECT *, lead(t) OVER ({over}) AS nx,
    coalesce(sum(length(t) + (NOT ends)::INTEGER) OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st
  FROM {name}_piece),
{name}_break AS (SELECT *, CASE WHEN nx IS NULL THEN 0
    WHEN regexp_matches(t, '{DOTS}') THEN 0
    WHEN ends AND regexp_matches(t, '{INIT}') THEN 0
    WHEN ends THEN 1
    WHEN regexp_matches(t, '{INIT}') AND regexp_matches(nx, '{NEXT_INIT}') THEN 0
    WHEN regexp_matches(t, '{NUM}') AND regexp_matches(nx, '{NEXT_NUM}') THEN 0 ELSE 1 END AS br
  FROM {name}_next),
{name}_group AS (SELECT *, coalesce(sum(br) OVER ({over}
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM {name}_break),
{name} AS (SELECT {keys}, g::INTEGER AS sent_idx,
    rtrim(string_agg(t || CASE WHEN ends THEN '' ELSE ' ' END, '' ORDER BY k), ' ') AS text,
    min(st)::BIGINT AS start_index, max(st + length(t))::BIGINT AS end_index
  FROM {name}_group GROUP BY {keys}, g)"""


SENT = sentences("sent", "documents", "doc_id", "text")

SPLIT = "CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'val' ELSE 'test' END"


def balanced(name: str, label: str) -> str:
    """CTE of labelled sentences with the larger class sampled down; needs ``sent``."""
    return f"""
{name}_all AS (SELECT doc_id, sent_idx, text AS sentence,
    CASE WHEN {label} = 0 THEN 0 ELSE 1 END AS label, {SPLIT} AS "set",
    md5('42:' || doc_id || ':' || sent_idx) AS h
  FROM sent JOIN labels USING (doc_id)),
{name}_size AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM {name}_all GROUP BY label)),
{name} AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h) AS r
  FROM {name}_all) WHERE r <= (SELECT n FROM {name}_size))"""


def log_odds(name: str, source: str, text: str, label: str) -> str:
    """CTE of word weights from a labelled source."""
    return f"""
{name}_count AS (SELECT token, count(*) FILTER (label = 1) AS n_pos,
    count(*) FILTER (label = 0) AS n_neg
  FROM (SELECT unnest({tokens(text)}) AS token, {label} AS label FROM {source}) GROUP BY token),
{name}_total AS (SELECT sum(n_pos) AS np, sum(n_neg) AS nn, count(*) AS v FROM {name}_count),
{name} AS (SELECT token, n_pos, n_neg,
    ln((n_pos + 1.0) / (np + 1.0 * v)::DOUBLE) - ln((n_neg + 1.0) / (nn + 1.0 * v)::DOUBLE) AS log_odds,
    round(1000000 * (ln((n_pos + 1.0)::DOUBLE / (np + 1.0 * v)::DOUBLE)
      - ln((n_neg + 1.0)::DOUBLE / (nn + 1.0 * v)::DOUBLE)))::BIGINT AS weight
  FROM {name}_count, {name}_total)"""


def margins(name: str, weights: str, source: str = "sent", text: str = "text") -> str:
    """CTE of the sum of word weights per sentence; 0 where no word is known."""
    return f"""
{name} AS (SELECT s.doc_id, s.sent_idx, coalesce(m.m, 0)::BIGINT AS m FROM {source} s LEFT JOIN
  (SELECT doc_id, sent_idx, sum(weight)::BIGINT AS m FROM
    (SELECT doc_id, sent_idx, unnest({tokens(text)}) AS token FROM {source})
    JOIN {weights} USING (token) GROUP BY doc_id, sent_idx) m USING (doc_id, sent_idx))"""


BAL = balanced("bal", "quality")
TRAIN = BAL + "," + log_odds("wts", "(SELECT * FROM bal WHERE \"set\" = 'train')", "sentence", "label")
CTRAIN = (
    balanced("cbal", "toxic")
    + ","
    + log_odds("cwts", "(SELECT * FROM cbal WHERE \"set\" = 'train')", "sentence", "label")
)
PROB = "round(1 / (1 + exp(-m / 1000000.0::DOUBLE)), 6)"
SCORED = f"""{SENT},{TRAIN},{margins("mrg", "wts")},
scored AS (SELECT s.*, m, (m > 0)::INTEGER AS is_arg, {PROB} AS arg_prob
  FROM sent s JOIN mrg USING (doc_id, sent_idx))"""
COMP = f"""{SCORED},{CTRAIN},{margins("cmrg", "cwts")},
comp AS (SELECT s.* EXCLUDE (m),
    CASE WHEN is_arg = 1 THEN CASE WHEN c.m > 0 THEN 'claim' ELSE 'premise' END END AS component,
    CASE WHEN is_arg = 1 THEN round(1 / (1 + exp(-c.m / 1000000.0::DOUBLE)), 6) END AS component_prob
  FROM scored s JOIN cmrg c USING (doc_id, sent_idx))"""
ARGS = f"""{SCORED},
args AS (SELECT doc_id, sent_idx, text,
    (row_number() OVER (PARTITION BY doc_id ORDER BY sent_idx) - 1)::INTEGER AS arg_idx
  FROM scored WHERE is_arg = 1)"""


def pairs(window: int) -> str:
    return f"""
pairs AS (SELECT a.doc_id, a.arg_idx AS source, b.arg_idx AS target, a.sent_idx AS source_sent,
    b.sent_idx AS target_sent, a.text AS source_text, b.text AS target_text
  FROM args a JOIN args b ON a.doc_id = b.doc_id AND a.arg_idx <> b.arg_idx
    AND b.arg_idx BETWEEN a.arg_idx - {window} AND a.arg_idx + {window})"""


NEGATIONS = "['not', 'no', 'never', 'nicht', 'kein', 'nie', 'pas', 'non', 'jamais', 'sin', 'nunca']"
# Class, weights of gap, overlap, length ratio and negation, bias.
CLASSES = (
    ("none", 0.25, -2.0, 0.0, 0.0, 0.0),
    ("inference", -0.25, 3.0, 0.5, -0.5, 0.25),
    ("conflict", -0.125, 1.0, 0.25, 2.0, -0.5),
    ("rephrase", -0.5, 6.0, 1.0, -1.0, -1.5),
)
_LOGITS = ", ".join(
    f"({bias}::DOUBLE + {a}::DOUBLE * gap + {b}::DOUBLE * overlap + {c}::DOUBLE * ratio + {d}::DOUBLE * neg)"
    f" AS z{i}"
    for i, (_, a, b, c, d, bias) in enumerate(CLASSES)
)
_TOP = "greatest(z0, z1, z2, z3)"
_E = " + ".join(f"exp(z{i} - {_TOP})" for i in range(4))
_P = ", ".join(f"exp(z{i} - {_TOP}) / ({_E}) AS q{i}" for i in range(4))
RELATIONS = f"""{ARGS},{pairs(5)},
words AS (SELECT doc_id, arg_idx, w, list_distinct(w) AS d, len(w) AS n,
    list_has_any(w, {NEGATIONS}) AS neg
  FROM (SELECT doc_id, arg_idx, {tokens("text")} AS w FROM args)),
feats AS (SELECT p.* EXCLUDE (source_text, target_text),
    len(list_intersect(a.d, b.d)) AS shared, len(a.d) + len(b.d) AS both_sides,
    least(a.n, b.n)::DOUBLE / greatest(a.n, b.n, 1) AS ratio,
    abs(source - target)::DOUBLE AS gap, (a.neg <> b.neg)::INTEGER::DOUBLE AS neg
  FROM pairs p JOIN words a ON a.doc_id = p.doc_id AND a.arg_idx = p.source
    JOIN words b ON b.doc_id = p.doc_id AND b.arg_idx = p.target),
logits AS (SELECT *, {_LOGITS} FROM
  (SELECT *, shared::DOUBLE / greatest(both_sides - shared, 1) AS overlap FROM feats)),
rel AS (SELECT *, CASE {_TOP} WHEN z0 THEN 'none' WHEN z1 THEN 'inference' WHEN z2 THEN 'conflict'
    ELSE 'rephrase' END AS type, greatest(q0, q1, q2, q3) AS prob FROM
  (SELECT *, {_P} FROM logits)),
edges AS (SELECT * FROM rel WHERE type NOT IN ('none', 'neither'))"""
QUALITY = """round(prob, 6) AS prob, round(q0, 6) AS p0, round(q1, 6) AS p1,
  round(q2, 6) AS p2, round(q3, 6) AS p3"""


def confusion_scores(source: str, by: str = "") -> str:
    """CTE ``cls``: support, precision, recall, F1 of every class in ``source``."""
    b = f"{by}, " if by else ""
    on = f"USING ({b}class)"
    return f"""
lab AS (SELECT {b}label AS class, count(*) AS support FROM {source} GROUP BY ALL),
prd AS (SELECT {b}prediction AS class, count(*) AS predicted FROM {source} GROUP BY ALL),
hit AS (SELECT {b}label AS class, count(*) AS hits FROM {source} WHERE label = prediction GROUP BY ALL),
cls0 AS (SELECT {b}class, coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted,
    coalesce(hits, 0) AS hits FROM lab FULL JOIN prd {on} LEFT JOIN hit {on}),
cls1 AS (SELECT *, CASE WHEN predicted = 0 THEN 0.0 ELSE hits / predicted::DOUBLE END AS precision,
    CASE WHEN support = 0 THEN 0.0 ELSE hits / support::DOUBLE END AS recall FROM cls0),
cls AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0
    ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM cls1)"""


def weighted(by: str = "") -> str:
    b = f"{by}, " if by else ""
    means = ", ".join(
        f"round(sum({m} * support) / sum(support), 6) AS {m}" for m in ("precision", "recall", "f1")
    )
    return f"SELECT {b}round(sum(hits) / sum(support)::DOUBLE, 6) AS accuracy, {means} FROM cls GROUP BY ALL"


HELD = f"""{SENT},{TRAIN},
held_text AS (SELECT doc_id, sent_idx, sentence AS text FROM bal WHERE "set" <> 'train'),
{margins("hm", "wts", "held_text")},
held AS (SELECT b.*, m, (m > 0)::INTEGER AS prediction FROM bal b JOIN hm USING (doc_id, sent_idx))"""
SPLIT_METRICS = f"""{HELD},{confusion_scores("held", '"set"')},
wide AS ({weighted('"set"')})"""
LONG_METRICS = f"""WITH {SPLIT_METRICS}
SELECT "set", metric, value FROM (UNPIVOT wide ON accuracy, precision, recall, f1
  INTO NAME metric VALUE value)"""

DOC_WEIGHTS = f"""
doc_text AS (SELECT d.doc_id, {CLEAN % "d.text"} AS clean, quality AS label
  FROM documents d JOIN labels USING (doc_id)),{log_odds("dwts", "doc_text", "clean", "label")}"""

DIGEST = "md5(concat_ws('|', source_text, target_text)) AS digest"
MICRO_LOGITS = f"""{SENT},
lg AS (SELECT doc_id, sent_idx, len({tokens("text")}) / 8.0::DOUBLE AS z0,
    length(text) / 64.0::DOUBLE AS z1, 1.0::DOUBLE AS z2 FROM sent),
ex AS (SELECT *, exp(z0 - greatest(z0, z1, z2)) AS e0, exp(z1 - greatest(z0, z1, z2)) AS e1,
    exp(z2 - greatest(z0, z1, z2)) AS e2 FROM lg),
pr AS (SELECT *, e0 / (e0 + e1 + e2) AS p0, e1 / (e0 + e1 + e2) AS p1,
    e2 / (e0 + e1 + e2) AS p2 FROM ex)"""
ARGMAX = "CASE greatest(z0, z1, z2) WHEN z0 THEN 0 WHEN z1 THEN 1 ELSE 2 END"
NETWORK = f"""{SENT},
nt AS (SELECT doc_id, sent_idx, 0.125::DOUBLE * len({tokens("text")}) - 1 AS z0,
    0.015625::DOUBLE * length(text) - 1 AS z1, 0.5::DOUBLE AS z2 FROM sent),
nx AS (SELECT *, exp(z0 - greatest(z0, z1, z2)) AS e0, exp(z1 - greatest(z0, z1, z2)) AS e1,
    exp(z2 - greatest(z0, z1, z2)) AS e2 FROM nt)"""

LABELLED = f"""{SENT},
labelled AS (SELECT doc_id, sent_idx, text AS sentence, quality,
    CASE WHEN quality = 0 THEN 'NoArgument' ELSE 'Argument' END AS annotation, {SPLIT} AS "set"
  FROM sent JOIN labels USING (doc_id))"""


def _pair_cut(keep: str, side: str) -> str:
    return f"list_slice({side}, 1, least(len({side}), {keep}))"


PAIR_CUT = f"""{ARGS},{pairs(1)},
two AS (SELECT doc_id, source, target, {tokens("source_text")} AS a, {tokens("target_text")} AS b FROM pairs),
cut AS (SELECT doc_id, source, target, len(a) AS la, len(b) AS lb,
    {_pair_cut("greatest(512 - len(b), 256)", "a")} AS a,
    {_pair_cut("greatest(512 - len(a), 256)", "b")} AS b FROM two)"""

HTML_TEXT = f"regexp_replace(html, '{HTML}', ' ', 'g')"
for _entity, _plain in (
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''"),
    ("&#39;", "''"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"),
):
    HTML_TEXT = f"replace({HTML_TEXT}, '{_entity}', '{_plain}')"

BALANCED_DOCS = """SELECT doc_id, {0} FROM (SELECT doc_id, {0},
    row_number() OVER (PARTITION BY {0} ORDER BY md5('42:' || doc_id), doc_id) AS r FROM labels)
  WHERE r <= (SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY {0}))"""



def training_rounds(n: str, classes: int, rounds: int, rate: int) -> str:
    """CTEs of losses by round in ``{n}_loss`` and weights in ``{n}_w1`` and so on.

    Needs ``{n}_row`` (rid, label, part) and ``{n}_item`` (rid, token, x in thousandths).
    """
    c = range(classes)
    parts = []
    for r in range(rounds + 1):
        if r == 0:
            z = f"SELECT rid, label, part, {', '.join(f'0::DOUBLE AS z{i}' for i in c)} FROM {n}_row"
        else:
            sums = ", ".join(f"coalesce(sum(x * w{i}), 0)::BIGINT::DOUBLE / 1000000000::DOUBLE AS z{i}" for i in c)
            z = f"""SELECT rid, any_value(label) AS label, any_value(part) AS part, {sums}
              FROM {n}_row JOIN {n}_item USING (rid) LEFT JOIN {n}_w{r} USING (token) GROUP BY rid"""
        top = f"greatest({', '.join(f'z{i}' for i in c)})"
        total = " + ".join(f"e{i}" for i in c)
        off = ", ".join(f"round(((label = {i})::INTEGER::DOUBLE - e{i} / ({total})) * 1000000)::BIGINT AS o{i}" for i in c)
        own = "CASE label " + " ".join(f"WHEN {i} THEN z{i}" for i in c) + " END"
        parts.append(f"""
{n}_z{r} AS MATERIALIZED ({z}),
{n}_o{r} AS MATERIALIZED (SELECT rid, label, part, {off}, round((ln({total}) - ({own} - {top})) * 1000000)::BIGINT AS loss
  FROM (SELECT *, {", ".join(f"exp(z{i} - {top}) AS e{i}" for i in c)} FROM {n}_z{r}))""")
        if r == rounds:
            break
        moves = ", ".join(f"sign(sum(x * o{i}))::BIGINT * ((abs(sum(x * o{i})) // sum(x)) * {rate} // 1000)::BIGINT AS d{i}" for i in c)
        before = f"FULL JOIN {n}_w{r} USING (token)" if r else ""
        added = ", ".join(f"coalesce(d{i}, 0) + {f'coalesce(w{i}, 0)' if r else '0'} AS w{i}" for i in c)
        parts.append(f"""
{n}_w{r + 1} AS MATERIALIZED (SELECT token, {added} FROM
  (SELECT token, {moves} FROM {n}_o{r} JOIN {n}_item USING (rid) WHERE part = 'train' GROUP BY token) {before})""")
    losses = " UNION ALL ".join(
        f"SELECT {r} AS round, sum(loss) FILTER (part = 'train')::BIGINT AS train_loss, "
        f"sum(loss) FILTER (part = 'val')::BIGINT AS val_loss FROM {n}_o{r}"
        for r in range(rounds + 1)
    )
    return ",".join(parts) + f""",
{n}_all AS MATERIALIZED ({losses}),
{n}_best AS (SELECT a.round, (SELECT b.round FROM {n}_all b WHERE b.round <= a.round ORDER BY b.val_loss, b.round LIMIT 1) AS best
  FROM {n}_all a),
{n}_stop AS (SELECT coalesce(min(round) FILTER (round - best >= 2), {rounds}) AS last FROM {n}_best),
{n}_loss AS (SELECT a.*, a.round = (SELECT best FROM {n}_best, {n}_stop WHERE round = last) AS chosen
  FROM {n}_all a, {n}_stop WHERE a.round <= last)"""


def words_of(n: str, text: str) -> str:
    """Words of ``{n}_text`` (rid, text...) and a bias, as items."""
    return f"""SELECT rid, token, 1000 * count(*) AS x FROM (SELECT rid, unnest({text}) AS token FROM {n}_text) GROUP BY ALL
  UNION ALL SELECT rid, chr(1) || 'bias', 1000 FROM {n}_text"""


LOSSES = "SELECT round, train_loss, val_loss, chosen FROM"
TRAINED = f"""{SENT},{BAL},
tr_text AS MATERIALIZED (SELECT row_number() OVER () AS rid, sentence, label, "set" AS part FROM bal WHERE "set" <> 'test'),
tr_row AS (SELECT rid, label, part FROM tr_text),
tr_item AS MATERIALIZED ({words_of("tr", tokens("sentence"))}),{training_rounds("tr", 2, 4, 100)}"""
_FEATURES = ("gap", "overlap", "len_ratio", "neg")
PAIRED = f"""{ARGS},
pr_pair AS MATERIALIZED (SELECT row_number() OVER () AS rid, a.arg_idx AS source, b.arg_idx AS target, {tokens("a.text")} AS a,
    {tokens("b.text")} AS b, CASE WHEN toxic = 1 THEN 2 WHEN quality = 1 THEN 1 ELSE 0 END AS label, {SPLIT} AS part
  FROM args a JOIN args b USING (doc_id) JOIN labels USING (doc_id) WHERE b.arg_idx - a.arg_idx BETWEEN 1 AND 2),
pr_text AS MATERIALIZED (SELECT *, list_distinct(a) AS da, list_distinct(b) AS db FROM pr_pair WHERE part <> 'test'),
pr_row AS (SELECT rid, label, part FROM pr_text),
pr_feature AS (SELECT rid, 1000 * abs(source - target) AS gap,
    round(1000 * (len(list_intersect(da, db))::DOUBLE / greatest(len(da) + len(db) - len(list_intersect(da, db)), 1)))::BIGINT AS overlap,
    round(1000 * (least(len(a), len(b))::DOUBLE / greatest(len(a), len(b), 1)))::BIGINT AS len_ratio,
    1000 * (list_has_any(a, {NEGATIONS}) <> list_has_any(b, {NEGATIONS}))::INTEGER AS neg FROM pr_text),
pr_item AS MATERIALIZED ({words_of("pr", "list_concat(a, b)")}
  {" ".join(f"UNION ALL SELECT rid, chr(1) || '{f}', {f} FROM pr_feature" for f in _FEATURES)}),{training_rounds("pr", 3, 4, 100)}"""
# The weights of the chosen round, and of every pair under them the three logits.
_CHOSEN = " UNION ALL ".join(f"SELECT token, w0, w1, w2 FROM pr_w{r} WHERE (SELECT round FROM pr_loss WHERE chosen) = {r}" for r in range(1, 5))


def _fitted_logit(i: int) -> str:
    def weight(name: str) -> str:
        return f"coalesce((SELECT w{i} FROM chosen WHERE token = chr(1) || '{name}'), 0)::DOUBLE / 1000000::DOUBLE"

    terms = " + ".join(f"{weight(f)} * {col}" for f, col in zip(_FEATURES, ("gap", "overlap", "ratio", "neg")))
    return f"({weight('bias')} + {terms} + (a_sum{i} + b_sum{i})::DOUBLE / 1000000::DOUBLE) AS y{i}"


_SUMS = ", ".join(f"coalesce(sum(w{i}), 0)::BIGINT AS sum{i}" for i in range(3))
_Y = "greatest(y0, y1, y2)"
_EY = " + ".join(f"exp(y{i} - {_Y})" for i in range(3))
FITTED = f"""{PAIRED},{pairs(5)},
chosen AS MATERIALIZED ({_CHOSEN}),
arg_word AS (SELECT doc_id, arg_idx, w, list_distinct(w) AS d, len(w) AS n, list_has_any(w, {NEGATIONS}) AS neg
  FROM (SELECT doc_id, arg_idx, {tokens("text")} AS w FROM args)),
arg_sum AS (SELECT doc_id, arg_idx, {_SUMS} FROM (SELECT doc_id, arg_idx, unnest(w) AS token FROM arg_word)
  JOIN chosen USING (token) GROUP BY ALL),
arg_all AS (SELECT w.*, {", ".join(f"coalesce(sum{i}, 0) AS sum{i}" for i in range(3))}
  FROM arg_word w LEFT JOIN arg_sum USING (doc_id, arg_idx)),
fit_pair AS (SELECT p.doc_id, source, target, abs(source - target)::DOUBLE AS gap,
    len(list_intersect(a.d, b.d))::DOUBLE / greatest(len(a.d) + len(b.d) - len(list_intersect(a.d, b.d)), 1) AS overlap,
    least(a.n, b.n)::DOUBLE / greatest(a.n, b.n, 1) AS ratio, (a.neg <> b.neg)::INTEGER::DOUBLE AS neg,
    {", ".join(f"a.sum{i} AS a_sum{i}, b.sum{i} AS b_sum{i}" for i in range(3))}
  FROM pairs p JOIN arg_all a ON a.doc_id = p.doc_id AND a.arg_idx = p.source
    JOIN arg_all b ON b.doc_id = p.doc_id AND b.arg_idx = p.target),
fit_logit AS (SELECT doc_id, source, target, {", ".join(_fitted_logit(i) for i in range(3))} FROM fit_pair),
fit AS (SELECT *, CASE {_Y} WHEN y0 THEN 'neither' WHEN y1 THEN 'support' ELSE 'attack' END AS type,
    {", ".join(f"exp(y{i} - {_Y}) / ({_EY}) AS q{i}" for i in range(3))} FROM fit_logit)"""
TRIAL_BIASES = "(VALUES (0, -4000000), (1, -2000000), (2, 0), (3, 2000000), (4, 4000000), (5, 0)) t(trial, bias)"

EXPORTED = """{'doc_id': doc_id, 'lang': lang, 'text': text, 'n_chars': n_chars,
    'note': CASE WHEN doc_id % 2 = 0 THEN lang END}"""
BIASES = "(VALUES (0, -4000000), (1, -2000000), (2, 0), (3, 2000000), (4, 4000000)) t(trial, bias)"

ORACLE: dict[str, str] = {
    "scan_corpus": "SELECT doc_id AS id, lang AS language FROM documents",
    "scan_glob": "SELECT doc_id, lang FROM documents WHERE lang = 'en'",
    "scan_partition": "SELECT doc_id AS id, lang AS language FROM documents WHERE lang = 'en'",
    "scan_labelled": f'WITH {LABELLED} SELECT doc_id, sentence, annotation, "set" FROM labelled',
    "resolve_content": "SELECT doc_id AS id, md5(text) AS digest FROM documents",
    "pending_inputs": f"""WITH {SENT} SELECT doc_id, lang FROM documents WHERE NOT
        (lang = 'en' AND doc_id IN (SELECT doc_id FROM sent))""",
    "failed_inputs": """SELECT DISTINCT 'lang=' || lang AS folder, NULL::BIGINT AS expected, 0::BIGINT AS read,
        'failed' AS status FROM documents WHERE lang = 'es'""",
    "relative_path": "SELECT doc_id AS id, 'language=' || lang AS folder FROM documents",
    "write_mirrored": f"""WITH {SENT} SELECT doc_id, sent_idx, lang, sent.text
        FROM sent JOIN documents USING (doc_id)""",
    "write_documents": f"""SELECT 'corpus/' || doc_id || '.json' AS key,
        md5(to_json({EXPORTED})::VARCHAR) AS digest FROM documents""",
    "document_key": "SELECT 'corpus/' || doc_id || '.json' AS key FROM documents",
    "index_export": f"""SELECT md5(to_json({EXPORTED})::VARCHAR) AS digest FROM documents
        UNION ALL SELECT md5('{{"index":{{"_index":"documents","_id":"' || doc_id || '"}}}}') FROM documents""",
    "metrics_table": LONG_METRICS,
    "save_model": f"WITH {SENT},{TRAIN} SELECT token, weight FROM wts",
    "run_report": """SELECT 'lang=' || lang AS folder, count(*) AS expected, count(*) AS read,
        'done' AS status FROM documents GROUP BY lang""",
    "cast_text": """SELECT doc_id, coalesce(quality::VARCHAR, '') AS quality
        FROM documents LEFT JOIN labels USING (doc_id)""",
    "drop_empty": f"SELECT doc_id, lang FROM documents WHERE {CLEAN % 'text'} <> ''",
    "binary_label": """SELECT doc_id, CASE WHEN quality = 0 THEN 0 ELSE 1 END AS label
        FROM documents LEFT JOIN labels USING (doc_id)""",
    "select_split": f"""WITH {LABELLED} SELECT doc_id, sent_idx, "set" FROM labelled WHERE "set" = 'val'""",
    "select_confident": f"WITH {RELATIONS} SELECT doc_id, source, target, type FROM edges WHERE prob >= 0.6",
    "prune_columns": f"""WITH {LABELLED} SELECT array_to_string({tokens("sentence")}, ' ') AS tokens,
        len({tokens("sentence")})::INTEGER AS n_tokens, quality AS label FROM labelled""",
    "filter_argumentative": f"WITH {SCORED} SELECT doc_id, sent_idx, text FROM scored WHERE is_arg = 1",
    "filter_linkable": f"""WITH {ARGS} SELECT doc_id, sent_idx FROM args WHERE doc_id IN
        (SELECT doc_id FROM args GROUP BY doc_id HAVING count(*) >= 2)""",
    "filter_relations": f"WITH {RELATIONS} SELECT doc_id, source, target, type FROM edges",
    "clean_text": f"SELECT doc_id, {CLEAN % 'text'} AS text FROM documents",
    "clean_html": f"""SELECT page_id, trim(regexp_replace(replace(replace({HTML_TEXT}, chr(1), ' '), chr(2), ' '),
        '{WS}', ' ', 'g'), ' ') AS html FROM pages""",
    "split_sentences": f"WITH {SENT} SELECT * FROM sent",
    "split_pages": f"WITH {sentences('sent', 'pages', 'page_id', 'html')} SELECT * FROM sent",
    "split_tight": f"""WITH tight_text AS (SELECT page_id, {CLEAN % 'html'} AS clean FROM pages UNION ALL
          SELECT -1 - doc_id, regexp_replace({CLEAN % 'text'}, '([.!?]) ([A-M])', '\\1(\\2', 'g') FROM documents),
        {tight_sentences("tight", "tight_text", "page_id", "clean")} SELECT * FROM tight""",
    "split_conversations": f"""WITH {sentences('sent', 'conversations', 'conv_id, turn', 'text')}
        SELECT * FROM sent""",
    "span_text": f"""WITH {SENT} SELECT doc_id, sent_idx,
        substring(clean, start_index + 1, end_index - start_index) AS span
        FROM sent JOIN sent_clean USING (doc_id)""",
    "flatten_positions": f"WITH {SENT} SELECT doc_id, sent_idx, text FROM sent",
    "tokenize_truncate": f"""WITH {SENT} SELECT doc_id, sent_idx,
        array_to_string(list_slice({tokens("text")}, 1, 128), ' ') AS tokens,
        least(len({tokens("text")}), 128)::INTEGER AS n_tokens FROM sent""",
    "tokenize_pair": f"""WITH {PAIR_CUT} SELECT doc_id, source, target, len(a)::INTEGER AS n_source,
        len(b)::INTEGER AS n_target, la::INTEGER AS n_source_uncut, lb::INTEGER AS n_target_uncut,
        array_to_string(a, ' ') AS source_tokens,
        array_to_string(b, ' ') AS target_tokens FROM cut""",
    "score_batches": f"""WITH {NETWORK} SELECT doc_id, sent_idx, ({ARGMAX})::INTEGER AS pred_id,
        CASE {ARGMAX} WHEN 0 THEN 'long' WHEN 1 THEN 'wide' ELSE 'plain' END AS pred,
        round(e0 / (e0 + e1 + e2), 6) AS p0, round(e1 / (e0 + e1 + e2), 6) AS p1 FROM nx""",
    "score_linear": f"""WITH {SENT},{DOC_WEIGHTS} SELECT s.doc_id, s.sent_idx,
        coalesce(sum(weight), 0)::BIGINT AS score, count(weight) AS n_known FROM sent s
        LEFT JOIN (SELECT doc_id, sent_idx, unnest({tokens("text")}) AS token FROM sent) t USING (doc_id, sent_idx)
        LEFT JOIN dwts USING (token) GROUP BY s.doc_id, s.sent_idx""",
    "score_linear_rowwise": f"""WITH {SENT},{DOC_WEIGHTS},{margins("mrg", "dwts")}
        SELECT doc_id, sent_idx, m AS score FROM mrg""",
    "score_linear_sharded": f"""WITH {SENT},{DOC_WEIGHTS},{margins("mrg", "dwts")}
        SELECT doc_id, sent_idx, m AS score FROM mrg""",
    "softmax": f"""WITH {MICRO_LOGITS} SELECT doc_id, sent_idx, round(p0, 6) AS p0, round(p1, 6) AS p1,
        round(p2, 6) AS p2 FROM pr""",
    "argmax": f"WITH {MICRO_LOGITS} SELECT doc_id, sent_idx, ({ARGMAX})::INTEGER AS class FROM lg",
    "label_of": f"""WITH {MICRO_LOGITS} SELECT doc_id, sent_idx,
        CASE {ARGMAX} WHEN 0 THEN 'neither' WHEN 1 THEN 'support' ELSE 'attack' END AS label FROM lg""",
    "prob_of": f"WITH {MICRO_LOGITS} SELECT doc_id, sent_idx, round(p1, 6) AS prob FROM pr",
    "detect_sentences": f"WITH {SCORED} SELECT doc_id, sent_idx, is_arg, arg_prob FROM scored",
    "classify_components": f"WITH {COMP} SELECT doc_id, sent_idx, is_arg, component, component_prob FROM comp",
    "classify_relations": f"WITH {RELATIONS} SELECT doc_id, source, target, type, {QUALITY} FROM rel",
    "windowed_pairs": f"""WITH {ARGS},{pairs(5)} SELECT doc_id, source, target, source_sent, target_sent,
        {DIGEST} FROM pairs""",
    "document_pairs": f"""WITH {ARGS},{pairs(5)} SELECT doc_id, source, target, source_sent, target_sent,
        {DIGEST} FROM pairs""",
    "attach_predictions": f"WITH {COMP} SELECT doc_id, sent_idx, component FROM comp",
    "resolve_endpoints": f"WITH {RELATIONS} SELECT doc_id, source, target, source_sent, target_sent FROM edges",
    "attach_to_documents": f"""WITH {RELATIONS} SELECT d.doc_id, lang, length(d.text)::INTEGER AS n_text,
        (SELECT count(*) FROM sent s WHERE s.doc_id = d.doc_id)::INTEGER AS n_sentences,
        (SELECT count(*) FROM edges e WHERE e.doc_id = d.doc_id)::INTEGER AS n_relations FROM documents d""",
    "arg_index": f"WITH {ARGS} SELECT doc_id, sent_idx, arg_idx FROM args",
    "group_by_document": f"""WITH {ARGS} SELECT d.doc_id,
        coalesce(string_agg(sent_idx::VARCHAR, ' ' ORDER BY sent_idx), '') AS positions
        FROM documents d LEFT JOIN args USING (doc_id) GROUP BY d.doc_id""",
    "assemble_sentences": f"""WITH {COMP} SELECT doc_id, sent_idx, text, start_index, end_index,
        is_arg = 1 AS is_arg, arg_prob, component, component_prob FROM comp""",
    "assemble_relations": f"""WITH {RELATIONS} SELECT doc_id, (row_number() OVER
        (PARTITION BY doc_id ORDER BY source, target) - 1)::INTEGER AS place, source, target, type FROM edges""",
    "relation_edges": f"WITH {RELATIONS} SELECT doc_id, source, target, type, {QUALITY} FROM edges",
    "class_counts": f"WITH {LABELLED} SELECT quality AS label, count(*) AS n FROM labelled GROUP BY quality",
    "balance_classes": BALANCED_DOCS.format("toxic"),
    "balance_classes_reverse": BALANCED_DOCS.format("quality"),
    "shuffle_rows": "SELECT doc_id, quality, toxic FROM labels",
    "stack_files": """SELECT doc_id, lang, NULL::BIGINT AS page_id, NULL AS url, NULL::BIGINT AS conv_id,
        NULL::BIGINT AS turn, NULL AS role FROM documents
        UNION ALL BY NAME SELECT page_id, url FROM pages
        UNION ALL BY NAME SELECT conv_id, turn, role FROM conversations""",
    "best_model": f"""WITH {HELD},
        tried AS (SELECT trial, label, (m + bias > 0)::INTEGER AS prediction FROM held, {BIASES}
          WHERE "set" = 'val'),{confusion_scores("tried", "trial")},
        trials AS ({weighted("trial")})
        SELECT trial, f1, accuracy FROM trials ORDER BY f1 DESC, trial LIMIT 1""",
    "best_model_loss": f"""WITH {HELD},
        tried AS (SELECT trial, (CASE WHEN label = 1 THEN -(m + bias) ELSE m + bias END) / 1000000::DOUBLE AS wrong
          FROM held, {TRIAL_BIASES} WHERE "set" = 'val'),
        trials AS (SELECT trial, count(*) AS rows,
          sum(round((greatest(wrong, 0) + ln(1 + exp(-abs(wrong)))) * 1000000)::BIGINT)::BIGINT AS loss_sum FROM tried GROUP BY trial),
        ends AS ((SELECT 'min' AS mode, * FROM trials ORDER BY loss_sum, trial LIMIT 1)
          UNION ALL (SELECT 'max', * FROM trials ORDER BY loss_sum DESC, trial LIMIT 1))
        SELECT mode, trial, rows, loss_sum, round(loss_sum::DOUBLE / rows / 1000000, 6) AS loss FROM ends""",
    "train_rounds": f"WITH {TRAINED} {LOSSES} tr_loss",
    "train_relations": f"WITH {PAIRED} {LOSSES} pr_loss",
    "relate_fitted": f"""WITH {FITTED} SELECT doc_id, source, target, type, round(greatest(q0, q1, q2), 6) AS prob,
        round(q0, 6) AS p0, round(q1, 6) AS p1, round(q2, 6) AS p2 FROM fit WHERE type NOT IN ('none', 'neither')""",
    "fit_vocabulary": f"""WITH {LABELLED},
        voc AS (SELECT token, count(*) AS n FROM (SELECT unnest({tokens("sentence")}) AS token
          FROM labelled WHERE "set" = 'train') GROUP BY token)
        SELECT token, n, row_number() OVER (ORDER BY n DESC, token) - 1 AS index FROM voc""",
    "train_log_odds": f"""WITH {DOC_WEIGHTS} SELECT token, n_pos, n_neg, weight,
        round(log_odds, 6) AS log_odds FROM dwts""",
    "prepare_splits": f'WITH {SENT},{BAL} SELECT doc_id, sent_idx, label, "set" FROM bal',
    "evaluate_binary": f'WITH {HELD},{confusion_scores("held")} {weighted()}',
    "evaluate_f1": f"""WITH {HELD}, acc AS (SELECT round(avg((label = prediction)::INTEGER), 6) AS a FROM held)
        SELECT a AS accuracy, a AS precision, a AS recall, a AS f1 FROM acc""",
    "evaluate_f1_subset": f"""WITH {COMP},
        three AS (SELECT CASE WHEN toxic = 1 THEN 2 WHEN quality = 1 THEN 1 ELSE 0 END AS label,
          CASE WHEN is_arg = 0 THEN 0 WHEN component = 'claim' THEN 2 ELSE 1 END AS prediction
          FROM comp JOIN labels USING (doc_id)),{confusion_scores("three")}
        SELECT round(sum(f1) / 2, 6) AS f1 FROM cls WHERE class IN (1, 2)""",
    "train_classifier": f"""WITH {SENT},{BAL} SELECT count(*) AS n, sum(label)::BIGINT AS n_arguments,
        true AS beats_guessing FROM bal WHERE "set" = 'train'""",
    "evaluate_splits": f'WITH {SPLIT_METRICS} SELECT * FROM wide',
    "incremental_sentences": f"WITH {SENT} SELECT * FROM sent",
    "preprocess_corpus": f"""WITH {SENT} SELECT doc_id AS id, lang AS language, sent_idx, sent.text,
        start_index, end_index FROM sent JOIN documents USING (doc_id)""",
    "preprocess_files": f"""WITH {SENT} SELECT doc_id AS id, lang AS language, sent_idx, sent.text
        FROM sent JOIN documents USING (doc_id)""",
    "score_corpus": f"""WITH {SCORED} SELECT doc_id, sent_idx, text, start_index, end_index, is_arg,
        arg_prob FROM scored""",
    "argument_share": f"""WITH {SCORED} SELECT doc_id, count(*) AS n_sentences,
        sum(is_arg)::BIGINT AS n_arguments, round(avg(is_arg), 6) AS share FROM scored GROUP BY doc_id""",
    "mine_arguments": f"""WITH {RELATIONS},{CTRAIN},{margins("cmrg", "cwts")},
        per_sent AS (SELECT doc_id, count(*) AS n_sentences, sum(is_arg) AS n_arguments,
          sum((is_arg = 1 AND c.m > 0)::INTEGER) AS n_claims
          FROM scored JOIN cmrg c USING (doc_id, sent_idx) GROUP BY doc_id),
        per_edge AS (SELECT doc_id, count(*) AS n_relations, sum(source_sent * 31 + target_sent) AS fingerprint,
          sum((type = 'conflict')::INTEGER) AS n_conflicts FROM edges GROUP BY doc_id)
        SELECT d.doc_id, lang, coalesce(n_sentences, 0)::INTEGER AS n_sentences,
          coalesce(n_arguments, 0)::BIGINT AS n_arguments, coalesce(n_claims, 0)::BIGINT AS n_claims,
          coalesce(n_relations, 0)::INTEGER AS n_relations, coalesce(fingerprint, 0)::BIGINT AS fingerprint,
          coalesce(n_conflicts, 0)::BIGINT AS n_conflicts
        FROM documents d LEFT JOIN per_sent USING (doc_id) LEFT JOIN per_edge USING (doc_id)""",
    "train_detector": LONG_METRICS,
}
