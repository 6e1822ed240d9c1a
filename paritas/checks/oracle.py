"""The checked queries as SQL for DuckDB, written independently of the operators:
AUC by average ranks, order by one global window, groups by regular expressions."""

from __future__ import annotations

from paritas.catalogue import IDENTITY_COLUMNS, METRIC_COLUMNS
from paritas.checks import fixtures as fx
from paritas.checks.queries import (
    DISPLAYED,
    EVAL_N,
    NO_ENTRY,
    OTHER_SEED,
    SAMPLE,
    TRAIN_N,
    TRUNCATED,
    YES_ENTRY,
)
from paritas.functions.text import ENGLISH_STOP_WORDS, TOKEN_PATTERN
from paritas.operators.classifier import VOCABULARY_SIZE
from paritas.operators.report import OVERALL_NAME, SECTIONS, report_header
from paritas.plans.candidates import PENALTIES, candidate_name

QUOTE = "chr(39)"


def _with(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


# --- input views ---


def _identity_sql(k: int, name: str) -> str:
    base = f"CASE WHEN (d.doc_id * 7 + {k}) % {k + 2} = 0 THEN 50 ELSE 0 END"
    value = f"CAST({base} + (d.doc_id * 13 + {k}) % 51 AS DOUBLE) / 100"
    if name == "other_disability":
        value = "CAST(0 AS DOUBLE)"
    elif name == "hindu":
        value = f"CASE WHEN l.toxic = 0 THEN {value} ELSE CAST(0 AS DOUBLE) END"
    return f"CASE WHEN (d.doc_id + {k}) % 11 <> 0 THEN {value} END AS {name}"


JIGSAW = f"""jigsaw AS (
  SELECT d.doc_id AS id,
    CASE WHEN d.doc_id % 50 <> 7 THEN d.text END AS comment_text,
    CAST(l.toxic * 50 + (d.doc_id * 37) % 50 AS DOUBLE) / 100 AS target,
    {", ".join(_identity_sql(k, name) for k, name in enumerate(IDENTITY_COLUMNS))}
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

PREPARED = f"""prepared AS (
  SELECT id, coalesce(comment_text, '') AS comment_text, target,
    CASE WHEN coalesce(target, 0) >= 0.5 THEN 1 ELSE 0 END AS is_toxic,
    {", ".join(f"coalesce({name}, CAST(0 AS DOUBLE)) AS {name}" for name in IDENTITY_COLUMNS)}
  FROM jigsaw)"""


def _scores(name: str, dataset: str) -> str:
    points = (
        "coalesce(l.toxic, 0) * 40 + (d.doc_id * 7919) % 61",
        "coalesce(l.toxic, 0) * 15 + (d.doc_id * 104729) % 86",
        "(d.doc_id * 611953) % 101",
    )
    parts = [
        f"""SELECT '{dataset}' AS dataset, '{model}' AS model, d.doc_id AS id,
      CAST({p} AS DOUBLE) / 100 AS score
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
        for model, p in zip(fx.SCORED_MODELS, points, strict=True)
    ]
    return f"{name} AS (" + "\n    UNION ALL ".join(parts) + ")"


SCORES = _scores("scores", fx.DATASET)
OOD_SCORES = _scores("ood_scores", fx.OOD_DATASET)

TOXIGEN = f"""toxigen AS (
  SELECT d.doc_id AS id, d.text AS generation,
    CASE d.doc_id % 8
      WHEN 0 THEN '[' || {QUOTE} || 'black' || {QUOTE} || ', ' || {QUOTE} || 'women' || {QUOTE} || ']'
      WHEN 1 THEN 'asian, latino' WHEN 2 THEN 'none' WHEN 4 THEN '[broken]'
      WHEN 5 THEN 'Black' WHEN 6 THEN 'jewish, , Unknown,jewish' WHEN 7 THEN '[]'
    END AS target_group,
    CAST(10 + l.toxic * 15 + (d.doc_id * 37) % 21 AS DOUBLE) / 10 AS toxicity_human,
    CASE WHEN d.doc_id % 4 <> 1 THEN 'test' ELSE 'train' END AS split
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

OOD_PREDICTIONS = f"""ood_predictions AS (
  SELECT s.* FROM ood_scores s JOIN toxigen t ON s.id = t.id
  WHERE t.split = 'test' OR s.model = '{fx.SCORED_MODELS[2]}')"""

LOGITS = """logits AS (
  SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS l0, CAST(embedding[2] AS DOUBLE) AS l1,
    embedding FROM embeddings)"""

MEMBERS = "members AS (" + "\n  UNION ALL ".join(
    f"SELECT id, {k} AS ord, '{name}' AS identity FROM prepared WHERE {name} > 0.5"
    for k, name in enumerate(IDENTITY_COLUMNS)
) + ")"

IDENTITIES = "identities(ord, identity) AS (VALUES " + ", ".join(
    f"({k}, '{name}')" for k, name in enumerate(IDENTITY_COLUMNS)
) + ")"

# Every scored row, once for the whole table (grp null) and once per membership.
SCORED_ROWS = """scored_rows AS (
  SELECT s.dataset, s.model, CAST(NULL AS VARCHAR) AS grp, s.score, p.is_toxic AS y
  FROM scores s JOIN prepared p ON s.id = p.id
  UNION ALL
  SELECT s.dataset, s.model, m.identity, s.score, p.is_toxic
  FROM scores s JOIN prepared p ON s.id = p.id JOIN members m ON m.id = p.id)"""


def _measured(rows: str, threshold: str = "0.5") -> str:
    """Metrics of each (dataset, model, grp) by average ranks (Mann and Whitney)."""
    return f"""ranked AS (
  SELECT *, rank() OVER (PARTITION BY dataset, model, grp ORDER BY score) AS lowest,
    count(*) OVER (PARTITION BY dataset, model, grp, score) AS peers
  FROM {rows}),
sums AS (
  SELECT dataset, model, grp, count(*) AS n, sum(y) AS p, count(*) - sum(y) AS q,
    sum(CASE WHEN y = 1 THEN 2 * lowest + peers - 1 ELSE 0 END) AS ranks2,
    sum(CASE WHEN y = 1 AND score >= {threshold} THEN 1 ELSE 0 END) AS tp,
    sum(CASE WHEN y = 0 AND score >= {threshold} THEN 1 ELSE 0 END) AS fp
  FROM ranked GROUP BY dataset, model, grp),
measured AS (
  SELECT dataset, model, grp, CAST(n AS BIGINT) AS n, CAST(p AS BIGINT) AS p,
    CAST(q AS BIGINT) AS q, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
    CASE WHEN p > 0 AND q > 0
      THEN CAST(ranks2 - p * (p + 1) AS DOUBLE) / CAST(2 * p * q AS DOUBLE) END AS auc,
    CASE WHEN p > 0 AND q > 0 THEN CAST(p - tp AS DOUBLE) / CAST(p AS DOUBLE) END AS fnr,
    CASE WHEN p > 0 AND q > 0 THEN CAST(fp AS DOUBLE) / CAST(q AS DOUBLE) END AS fpr
  FROM sums)"""


MEASURED_CTES = (JIGSAW, PREPARED, SCORES, MEMBERS, SCORED_ROWS, _measured("scored_rows"))


def _bias(models: tuple[str, ...], dataset: str = fx.DATASET) -> str:
    registry = ", ".join(f"('{dataset}', '{model}')" for model in models)
    return f"""registry(dataset, model) AS (VALUES {registry}),
bias AS (
  SELECT r.dataset, r.model, CAST(i.ord AS INTEGER) AS ord, i.identity,
    coalesce(g.n, 0) AS total_examples,
    o.auc AS overall_auc, o.fnr AS overall_fnr, o.fpr AS overall_fpr,
    g.auc AS subgroup_auc, g.fnr AS subgroup_fnr, g.fpr AS subgroup_fpr
  FROM registry r CROSS JOIN identities i
  LEFT JOIN measured o ON o.dataset = r.dataset AND o.model = r.model AND o.grp IS NULL
  LEFT JOIN measured g ON g.dataset = r.dataset AND g.model = r.model AND g.grp = i.identity)"""


BIAS_CTES = (*MEASURED_CTES, IDENTITIES, _bias(fx.MODEL_KEYS))


def _shuffled(source: str, name: str, seed: int = 42) -> str:
    return f"""{name} AS (
  SELECT id, row_number() OVER (ORDER BY md5(concat('{seed}:', id)), id) - 1 AS position,
    count(*) OVER () AS total
  FROM {source})"""


TRAIN_ROWS = "CAST(floor(CAST(0.9 AS DOUBLE) * total) AS BIGINT)"


# --- out of domain ---

# Readable list items are in single quotes; anything else in brackets is verbatim.
OOD_GROUPS = f"""raw_groups AS (
  SELECT id, CASE
      WHEN target_group IS NULL THEN CAST([] AS VARCHAR[])
      WHEN target_group = '[]' THEN CAST([] AS VARCHAR[])
      WHEN target_group LIKE '[%' AND target_group LIKE '%]' AND contains(target_group, {QUOTE})
        THEN regexp_extract_all(target_group, {QUOTE} || '([^' || {QUOTE} || ']*)' || {QUOTE}, 1)
      WHEN target_group LIKE '[%' AND target_group LIKE '%]' THEN [target_group]
      ELSE regexp_split_to_array(trim(target_group), ' *, *') END AS items
  FROM ood_table),
exploded AS (
  SELECT id, unnest(items) AS grp, generate_subscripts(items, 1) AS i FROM raw_groups),
first_places AS (
  SELECT id, grp, min(i) AS i FROM exploded
  WHERE grp <> '' AND lower(grp) NOT IN ('none', 'nan', 'null', 'unknown')
  GROUP BY id, grp),
ood_members AS (
  SELECT id, grp AS "group", row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS place
  FROM first_places),
catalogue AS (
  SELECT "group", min(id) AS first_row, CAST(arg_min(place, id) AS INTEGER) AS first_place
  FROM ood_members GROUP BY "group")"""

OOD_LABELLED = """ood_labelled AS (
  SELECT id, CASE WHEN toxicity_human > 3 THEN 1 ELSE 0 END AS y FROM ood_table)"""

OOD_ROWS = """ood_rows AS (
  SELECT s.dataset, s.model, CAST(NULL AS VARCHAR) AS grp, s.score, t.y
  FROM ood_scores s JOIN ood_labelled t ON s.id = t.id
  UNION ALL
  SELECT s.dataset, s.model, m."group", s.score, t.y
  FROM ood_scores s JOIN ood_labelled t ON s.id = t.id JOIN ood_members m ON m.id = t.id)"""


def _ood_table(where: str = "TRUE", group: str = "target_group") -> str:
    return f"""ood_table AS (
  SELECT id, generation, {group} AS target_group, toxicity_human, split
  FROM toxigen WHERE {where})"""


def _ood_bias(where: str = "TRUE", group: str = "target_group") -> str:
    models = ", ".join(f"('{m}')" for m in fx.SCORED_MODELS)
    overall = ", ".join(f"o.{m} AS overall_{m}" for m in ("auc", "fnr", "fpr"))
    subgroup = ", ".join(f"g.{m} AS subgroup_{m}" for m in ("auc", "fnr", "fpr"))
    return _with(
        TOXIGEN,
        _ood_table(where, group),
        OOD_GROUPS,
        OOD_LABELLED,
        OOD_SCORES,
        OOD_ROWS,
        _measured("ood_rows"),
        f"registry(model) AS (VALUES {models})",
        """wanted AS (
  SELECT * FROM catalogue
  UNION ALL SELECT 'placeholder', 0, 0 WHERE NOT EXISTS (SELECT 1 FROM catalogue))""",
        select=f"""SELECT r.model, c."group" AS identity, c.first_row, c.first_place,
  coalesce(g.n, 0) AS total_examples, {overall}, {subgroup}
FROM registry r CROSS JOIN wanted c
LEFT JOIN measured o ON o.model = r.model AND o.grp IS NULL
LEFT JOIN measured g ON g.model = r.model AND g.grp = c."group" """,
    )


def _ood_label(expression: str) -> str:
    return _with(TOXIGEN, select=f"SELECT id, {expression} AS label FROM toxigen")


# --- report ---


def _report_columns(metrics: tuple[str, ...]) -> str:
    return ", ".join(
        f"""max(CASE WHEN model = '{model}' THEN {metric} END) AS "{report_header(model, metric)}\""""
        for model in fx.MODEL_KEYS
        for metric in metrics
    )


def _report(metrics: tuple[str, ...], identity: str, extra: str = "", where: str = "") -> str:
    return _with(
        *BIAS_CTES,
        select=f"""SELECT {identity} AS identity, {extra}{_report_columns(metrics)}
FROM bias {where} GROUP BY ord, identity""",
    )


BASE_ROWS = """base_rows AS (
  SELECT id, comment_text AS sentence, 'Jigsaw' AS dataset, is_toxic AS true_label FROM prepared
  UNION ALL
  SELECT id, generation, 'ToxiGen', CASE WHEN toxicity_human > 3 THEN 1 ELSE 0 END
  FROM toxigen WHERE split = 'test')"""

ALL_PREDICTIONS = """all_predictions AS (
  SELECT * FROM scores UNION ALL SELECT * FROM ood_predictions)"""

GATE = f"""gate AS (
  SELECT b.dataset, r.model, b.n AS rows, coalesce(p.n, 0) AS predictions,
    coalesce(p.n, 0) > 0 AND coalesce(p.n, 0) = b.n AS complete
  FROM (SELECT dataset, count(*) AS n FROM base_rows GROUP BY dataset) b
  CROSS JOIN (VALUES {", ".join(f"('{key}')" for key in fx.MODEL_KEYS)}) r(model)
  LEFT JOIN (SELECT dataset, model, count(*) AS n FROM all_predictions GROUP BY dataset, model) p
    ON p.dataset = b.dataset AND p.model = r.model)"""

PREDICTION_CTES = (
    JIGSAW,
    PREPARED,
    SCORES,
    TOXIGEN,
    OOD_SCORES,
    OOD_PREDICTIONS,
    BASE_ROWS,
    ALL_PREDICTIONS,
    GATE,
)


def _prediction_column(i: int, model) -> str:
    return f"""(SELECT CASE WHEN p.score >= 0.5 THEN 1 ELSE 0 END
    FROM all_predictions p JOIN gate g ON g.dataset = p.dataset AND g.model = p.model
    WHERE g.complete AND p.model = '{model.key}' AND p.dataset = b.dataset AND p.id = b.id)
    AS "{model.prediction_header}\""""


LISTING = """listing AS (
  SELECT CASE doc_id % 6
    WHEN 0 THEN 'baseline_metrics.csv'
    WHEN 1 THEN 'org_' || source || '_raw_metrics.csv'
    WHEN 2 THEN 'org_' || source || '_finetuned_metrics.csv'
    WHEN 3 THEN 'final_report.csv'
    WHEN 4 THEN 'ood_toxigen_metrics.csv'
    ELSE 'preds_org_' || source || '_raw.csv' END AS file
  FROM documents)"""

MODEL_LISTING = """model_listing AS (
  SELECT lang || '/' || source AS folder,
    CASE WHEN lang = 'de' AND doc_id % 7 = 0 THEN 'config.json'
      WHEN doc_id % 11 = 0 THEN 'runs'
      ELSE 'checkpoint-' || doc_id END AS entry
  FROM documents)"""


# --- text ---

TOKENS = f"""texts AS (SELECT id, comment_text AS text FROM prepared),
tokens AS (
  SELECT id, regexp_extract_all(lower(text), '{TOKEN_PATTERN}') AS tokens FROM texts),
words AS (
  SELECT id, unnest(tokens) AS term, generate_subscripts(tokens, 1) AS i FROM tokens),
stop(term) AS (VALUES {", ".join("('" + w.replace("'", "''") + "')" for w in ENGLISH_STOP_WORDS)}),
kept AS (SELECT w.* FROM words w ANTI JOIN stop s ON w.term = s.term),
counts AS (SELECT id, term, count(*) AS n FROM kept GROUP BY id, term),
stats AS (
  SELECT term, CAST(sum(n) AS BIGINT) AS tf, count(*) AS df FROM counts GROUP BY term),
vocabulary AS (SELECT * FROM stats ORDER BY tf DESC, term LIMIT {VOCABULARY_SIZE}),
weights AS (
  SELECT term, tf, df, ln((CAST(1 AS DOUBLE) + (SELECT count(*) FROM texts))
    / (CAST(1 AS DOUBLE) + df)) + 1 AS idf FROM vocabulary)"""

TOKEN_CTES = (JIGSAW, PREPARED, TOKENS)


def _token_digest(words: str) -> str:
    return _with(
        *TOKEN_CTES,
        select=f"""SELECT t.id, coalesce(w.n, 0) AS n_tokens, md5(coalesce(w.joined, '')) AS digest
FROM texts t LEFT JOIN (
  SELECT id, count(*) AS n, string_agg(term, ' ' ORDER BY i) AS joined FROM {words} GROUP BY id) w
ON w.id = t.id""",
    )


# --- scoring stubs ---


def _sigmoid(x: str) -> str:
    return f"1 / (1 + exp(-({x})))"


LENGTH_LOGIT = (
    "CAST(CAST(CAST(length(comment_text) % 61 - 30 AS DOUBLE) / 10 AS FLOAT) AS DOUBLE)"
)
PROMPT = "'Comment: \"' || comment_text || '\"' || chr(10) || 'Is this comment toxic? Answer:'"
YES_NO_LOGIT = f"CAST(CAST(CAST(length({PROMPT}) % 37 AS DOUBLE) / 10 AS FLOAT) AS DOUBLE) - 1.75"


def _stub_bias(name: str, logit: str) -> str:
    return _with(
        JIGSAW,
        PREPARED,
        f"""scores AS (
  SELECT '{fx.DATASET}' AS dataset, '{name}' AS model, id, {_sigmoid(logit)} AS score
  FROM prepared)""",
        MEMBERS,
        SCORED_ROWS,
        _measured("scored_rows"),
        IDENTITIES,
        _bias((name,)),
        select="SELECT * FROM bias",
    )


def _ratio(name: str) -> str:
    return _with(
        *MEASURED_CTES,
        select=f"SELECT dataset, model, {name} FROM measured WHERE grp IS NULL",
    )


def _split(select: str, seed: int = 42) -> str:
    return _with(JIGSAW, PREPARED, _shuffled("prepared", "shuffled", seed), select=select)


def _prepared(columns: str) -> str:
    return _with(JIGSAW, PREPARED, select=f"SELECT {columns} FROM prepared")


def _slice(condition: str) -> str:
    return _split(
        f"""SELECT s.id, p.is_toxic FROM shuffled s JOIN prepared p ON s.id = p.id
WHERE {condition}"""
    )


KEPT = f"least({TRUNCATED}, total)"
TRUNCATED_TRAIN = f"CAST(floor(CAST(0.9 AS DOUBLE) * {KEPT}) AS BIGINT)"

INCOMPLETE = f"""scores AS (
  SELECT dataset, model, score,
    CASE WHEN model = '{fx.SCORED_MODELS[2]}' AND id % 10 = 3 THEN id - 1 ELSE id END AS id
  FROM raw_scores WHERE NOT (model = '{fx.SCORED_MODELS[1]}' AND id % 10 = 3)),
whole AS (
  SELECT model FROM scores GROUP BY model
  HAVING count(*) = (SELECT count(*) FROM prepared)
    AND count(DISTINCT id) = (SELECT count(*) FROM prepared))"""


def _if_whole(name: str) -> str:
    return f"CASE WHEN model IN (SELECT model FROM whole) THEN {name} END AS {name}"


TRAIN_TEXTS = f"""train_rows AS (
  SELECT p.* FROM shuffled s JOIN prepared p ON s.id = p.id WHERE position < {TRAIN_ROWS})"""
EVAL_ROWS = f"""eval_rows AS (
  SELECT p.* FROM shuffled s JOIN prepared p ON s.id = p.id WHERE position >= {TRAIN_ROWS})"""
SHUFFLED_CTES = (JIGSAW, PREPARED, _shuffled("prepared", "shuffled"))

ORACLE: dict[str, str] = {
    "incomplete_predictions_metrics": _with(
        JIGSAW,
        PREPARED,
        _scores("raw_scores", fx.DATASET),
        INCOMPLETE,
        MEMBERS,
        SCORED_ROWS,
        _measured("scored_rows"),
        IDENTITIES,
        _bias(fx.MODEL_KEYS),
        select="SELECT dataset, model, ord, identity, total_examples, "
        + ", ".join(_if_whole(name) for name in METRIC_COLUMNS)
        + " FROM bias",
    ),
    "baseline_train_summary": _with(
        *SHUFFLED_CTES,
        TRAIN_TEXTS,
        TOKENS.replace("FROM prepared)", "FROM train_rows)"),
        select=f"""SELECT count(*) AS n_train, CAST(sum(is_toxic) AS BIGINT) AS n_positive,
  (SELECT least({VOCABULARY_SIZE}, count(*)) FROM stats) AS vocabulary_size,
  TRUE AS gradient_small FROM train_rows""",
    ),
    "baseline_scores": _with(
        *SHUFFLED_CTES,
        EVAL_ROWS,
        select="SELECT id, is_toxic, TRUE AS as_recomputed FROM eval_rows",
    ),
    "baseline_bias_metrics": _with(
        *SHUFFLED_CTES,
        EVAL_ROWS,
        MEMBERS.replace("FROM prepared", "FROM eval_rows"),
        IDENTITIES,
        select=f"""SELECT '{fx.DATASET}' AS dataset, 'Baseline' AS model,
  CAST(i.ord AS INTEGER) AS ord, i.identity, count(m.id) AS total_examples,
  TRUE AS auc_as_by_ranks
FROM identities i LEFT JOIN members m ON m.identity = i.identity GROUP BY i.ord, i.identity""",
    ),
    "baseline_ood_scores": _with(
        TOXIGEN,
        select="""SELECT id, CASE WHEN toxicity_human > 3 THEN 1 ELSE 0 END AS label,
  TRUE AS as_recomputed FROM toxigen WHERE split = 'test'""",
    ),
    "baseline_ood_bias_metrics": _with(
        TOXIGEN,
        _ood_table("split = 'test'"),
        OOD_GROUPS,
        select="""SELECT 'Baseline' AS model, c."group" AS identity, c.first_row, c.first_place,
  count(*) AS total_examples, TRUE AS auc_as_by_ranks
FROM catalogue c JOIN ood_members m ON m."group" = c."group"
GROUP BY c."group", c.first_row, c.first_place""",
    ),
    "epoch_selection": """SELECT 3::BIGINT AS n_epochs, 2::BIGINT AS n_kept,
  TRUE AS better_than_chance, TRUE AS saved_is_best""",
    "candidate_selection": _with(
        JIGSAW,
        PREPARED,
        select=f"""SELECT m AS model, (SELECT count(*) - CAST(floor(CAST(0.9 AS DOUBLE) * count(*))
  AS BIGINT) FROM prepared) AS n_rows, TRUE AS chosen_is_best
FROM (VALUES {", ".join(f"('{candidate_name(p)}')" for p in PENALTIES)}) v(m)""",
    ),
    "prep_binarize_target": _prepared("id, target, is_toxic"),
    "prep_clean_text": _prepared("id, comment_text"),
    "prep_identity_fill": _prepared("id, " + ", ".join(IDENTITY_COLUMNS)),
    "prep_full": _prepared("*"),
    "prep_keep_null_text": _with(
        JIGSAW,
        PREPARED,
        select="""SELECT p.* REPLACE (j.comment_text AS comment_text)
FROM prepared p JOIN jigsaw j ON p.id = j.id""",
    ),
    "subgroup_membership": _with(
        JIGSAW, PREPARED, MEMBERS, select="SELECT id, identity FROM members"
    ),
    "identity_unpivot": _with(
        JIGSAW,
        PREPARED,
        select="\nUNION ALL ".join(
            f"SELECT id, {k} AS ord, '{name}' AS identity, {name} AS score FROM prepared"
            for k, name in enumerate(IDENTITY_COLUMNS)
        ),
    ),
    "binarize_scores": _with(
        SCORES,
        select="""SELECT dataset, model, id, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS prediction
FROM scores""",
    ),
    "seeded_shuffle_rank": _split("SELECT id, position FROM shuffled"),
    "split_90_10": _split(
        f"""SELECT id, CASE WHEN position < {TRAIN_ROWS} THEN 'train' ELSE 'eval' END AS split
FROM shuffled"""
    ),
    "split_counts": _split(
        f"""SELECT CASE WHEN position < {TRAIN_ROWS} THEN 'train' ELSE 'eval' END AS split,
  count(*) AS n FROM shuffled GROUP BY ALL"""
    ),
    "slice_train": _slice(f"position < {TRAIN_ROWS} AND position < {TRAIN_N}"),
    "slice_eval": _slice(
        f"position >= {TRAIN_ROWS} AND position < {TRAIN_ROWS} + {EVAL_N}"
    ),
    "slice_train_all": _slice(f"position < {TRAIN_ROWS}"),
    "truncate_then_split": _split(
        f"""SELECT id, CASE WHEN position < {TRUNCATED_TRAIN} THEN 'train' ELSE 'validation' END
  AS split FROM shuffled WHERE position < {KEPT}""",
        OTHER_SEED,
    ),
    "ood_sample": _with(
        TOXIGEN,
        _shuffled("toxigen", "shuffled"),
        select=f"""SELECT s.id, t.target_group FROM shuffled s JOIN toxigen t ON s.id = t.id
WHERE position < {SAMPLE}""",
    ),
    "split_leakage": _with(
        JIGSAW,
        PREPARED,
        _shuffled("prepared", "shuffled"),
        _shuffled("prepared", "other", OTHER_SEED),
        select=f"""SELECT count(*) AS leaked FROM shuffled s JOIN other o ON s.id = o.id
WHERE s.position >= {TRAIN_ROWS.replace("total", "s.total")}
  AND o.position < {TRAIN_ROWS.replace("total", "o.total")}""",
    ),
    "confusion_counts": _with(
        *MEASURED_CTES,
        select="""SELECT dataset, model, grp AS identity, q - fp AS tn, fp, p - tp AS fn, tp
FROM measured""",
    ),
    "overall_fnr": _ratio("fnr"),
    "overall_fpr": _ratio("fpr"),
    "overall_auc": _ratio("auc"),
    "subgroup_auc": _with(
        *MEASURED_CTES,
        select="SELECT dataset, model, grp AS identity, auc FROM measured WHERE grp IS NOT NULL",
    ),
    "subgroup_rates": _with(
        *MEASURED_CTES,
        select="""SELECT dataset, model, grp AS identity, fnr, fpr FROM measured
WHERE grp IS NOT NULL""",
    ),
    "subgroup_sizes": _with(
        *MEASURED_CTES,
        select="""SELECT dataset, model, grp AS identity, n AS total_examples FROM measured
WHERE grp IS NOT NULL""",
    ),
    "auc_prefix_counts": _with(
        JIGSAW,
        PREPARED,
        SCORES,
        MEMBERS,
        SCORED_ROWS,
        """by_score AS (
  SELECT dataset, model, grp, score, CAST(sum(y) AS BIGINT) AS pos,
    CAST(count(*) - sum(y) AS BIGINT) AS neg
  FROM scored_rows GROUP BY dataset, model, grp, score)""",
        select="""SELECT dataset, model, grp AS identity, score, pos, neg,
  CAST(sum(neg) OVER (PARTITION BY dataset, model, grp ORDER BY score) - neg AS BIGINT)
    AS neg_below FROM by_score""",
    ),
    "bias_metrics": _with(*BIAS_CTES, select="SELECT * FROM bias"),
    "empty_identity_rows": _with(
        *BIAS_CTES, select="SELECT * FROM bias WHERE total_examples = 0"
    ),
    "metrics_flat": _with(
        *BIAS_CTES,
        select="SELECT dataset, model, 'roc_auc' AS metric, overall_auc AS value FROM bias "
        "WHERE ord = 0\n"
        + "\n".join(
            f"""UNION ALL SELECT dataset, model, identity || '_{m}' AS metric, {m} AS value
FROM bias WHERE {m} IS NOT NULL"""
            for m in METRIC_COLUMNS[3:]
        ),
    ),
    "best_run": _with(
        *BIAS_CTES,
        select="""SELECT model AS run, overall_auc AS auc FROM bias
WHERE ord = 0 AND overall_auc IS NOT NULL ORDER BY overall_auc DESC, model LIMIT 1""",
    ),
    "bias_gap": _with(
        *BIAS_CTES,
        select="SELECT dataset, model, identity, "
        + ", ".join(f"subgroup_{m} - overall_{m} AS {m}_gap" for m in ("auc", "fnr", "fpr"))
        + " FROM bias",
    ),
    "ood_test_filter": _with(
        TOXIGEN, select="SELECT id, split FROM toxigen WHERE split = 'test'"
    ),
    "ood_label_human": _ood_label("CASE WHEN toxicity_human > 3 THEN 1 ELSE 0 END"),
    "ood_label_as_is": _ood_label("CASE WHEN toxicity_human > 2 THEN 1 ELSE 0 END"),
    "ood_label_score": _ood_label("CASE WHEN toxicity_human / 5 >= 0.5 THEN 1 ELSE 0 END"),
    "ood_label_classifier": _ood_label(
        "CASE WHEN toxicity_human / 5 >= 0.5 THEN 1 ELSE 0 END"
    ),
    "ood_text_column": _with(
        TOXIGEN,
        select="SELECT id, md5(generation) AS digest, length(generation) AS n_chars FROM toxigen",
    ),
    "ood_parse_groups": _with(
        TOXIGEN,
        _ood_table(),
        OOD_GROUPS,
        select="""SELECT t.id, coalesce(string_agg(m."group", '|' ORDER BY m."group"), '') AS groups,
  CAST(count(m."group") AS INTEGER) AS n_groups
FROM toxigen t LEFT JOIN ood_members m ON m.id = t.id GROUP BY t.id""",
    ),
    "ood_group_membership": _with(
        TOXIGEN, _ood_table(), OOD_GROUPS, select='SELECT id, "group" FROM ood_members'
    ),
    "ood_group_catalog": _with(
        TOXIGEN, _ood_table(), OOD_GROUPS, select="SELECT * FROM catalogue"
    ),
    "ood_bias_metrics": _ood_bias("split = 'test'"),
    "ood_bias_metrics_unfiltered": _ood_bias(),
    "ood_bias_metrics_without_id": "SELECT * EXCLUDE (first_row, first_place) FROM ("
    + _ood_bias("split = 'test'")
    + ")",
    "metric_files_without_totals": _with(
        *BIAS_CTES,
        select="""SELECT model, CAST(ord AS BIGINT) AS ord, identity,
  CAST(NULL AS BIGINT) AS total_examples, """
        + ", ".join(METRIC_COLUMNS)
        + " FROM bias",
    ),
    "report_preview": _with(
        *BIAS_CTES,
        select=f"""SELECT * FROM bias WHERE model = '{fx.MODEL_KEYS[0]}' ORDER BY ord LIMIT 10""",
    ),
    "report_file_roundtrip": _with(
        *BIAS_CTES,
        select=f"""SELECT identity, total_examples, overall_auc AS auc FROM bias
WHERE model = '{fx.MODEL_KEYS[0]}'""",
    ),
    "ood_no_groups": _ood_bias(group="'none, Unknown'"),
    "final_report": _report(
        METRIC_COLUMNS,
        "identity",
        "ord, max(CASE WHEN model = 'Baseline' THEN total_examples END) AS total_examples, ",
    ),
    "report_overall_auc": _report(
        SECTIONS["overall_auc"], f"'{OVERALL_NAME}'", where="WHERE ord = 0"
    ),
    "report_subgroup_auc": _report(SECTIONS["subgroup_auc"], "identity"),
    "report_fnr": _report(SECTIONS["fnr"], "identity"),
    "report_fpr": _report(SECTIONS["fpr"], "identity"),
    "prediction_count_gate": _with(*PREDICTION_CTES, select="SELECT * FROM gate"),
    "final_predictions": _with(
        *PREDICTION_CTES,
        select="SELECT b.sentence, b.dataset, b.true_label,\n  "
        + ",\n  ".join(_prediction_column(i, m) for i, m in enumerate(fx.REGISTRY))
        + "\nFROM base_rows b",
    ),
    "model_display_names": f"""SELECT doc_id AS id, 'org_' || source AS safe_name,
  coalesce(r.model, 'org_' || source) AS model
FROM documents LEFT JOIN (VALUES {", ".join(f"('{m}')" for m in DISPLAYED)}) r(model)
  ON replace(r.model, '/', '_') = 'org_' || source""",
    "result_file_names": _with(
        LISTING,
        select="""SELECT file,
  CASE WHEN file = 'baseline_metrics.csv' THEN 'Baseline'
    ELSE regexp_replace(file, '_(raw|finetuned)_metrics\\.csv$', '') END AS safe_name,
  CASE WHEN file = 'baseline_metrics.csv' THEN 'baseline'
    WHEN file LIKE '%\\_raw\\_metrics.csv' ESCAPE '\\' THEN 'raw' ELSE 'finetuned' END AS phase
FROM listing
WHERE file = 'baseline_metrics.csv' OR regexp_matches(file, '_(raw|finetuned)_metrics\\.csv$')""",
    ),
    "latest_checkpoint": _with(
        MODEL_LISTING,
        """numbered AS (
  SELECT folder, entry,
    CASE WHEN entry LIKE 'checkpoint-%' THEN CAST(split_part(entry, '-', -1) AS BIGINT) END AS step
  FROM model_listing)""",
        select="""SELECT folder, CASE
    WHEN bool_or(entry = 'config.json') OR max(step) IS NULL THEN folder
    ELSE folder || '/checkpoint-' || max(step) END AS path
FROM numbered GROUP BY folder""",
    ),
    "softmax_two_class": _with(
        LOGITS, select="SELECT id, round(exp(l1) / (exp(l0) + exp(l1)), 6) AS score FROM logits"
    ),
    "sigmoid_one_logit": _with(
        LOGITS, select=f"SELECT id, round({_sigmoid('l0')}, 6) AS score FROM logits"
    ),
    "logits_to_score": _with(
        LOGITS,
        select=f"""SELECT id, round(CASE WHEN id % 2 = 1 THEN exp(l1) / (exp(l0) + exp(l1))
  ELSE {_sigmoid("l0")} END, 6) AS score FROM logits""",
    ),
    "zero_shot_score": _with(
        LOGITS,
        select=f"""SELECT id, round(exp(CAST(embedding[{YES_ENTRY + 1}] AS DOUBLE))
  / (exp(CAST(embedding[{YES_ENTRY + 1}] AS DOUBLE))
    + exp(CAST(embedding[{NO_ENTRY + 1}] AS DOUBLE))), 6) AS score FROM logits""",
    ),
    "zero_shot_prompt": _prepared(
        f"id, md5({PROMPT}) AS digest, length({PROMPT}) AS n_chars"
    ),
    "tokenize": _token_digest("words"),
    "tokenize_no_stopwords": _token_digest("kept"),
    "vocabulary_topk": _with(*TOKEN_CTES, select="SELECT term, tf FROM vocabulary"),
    "vocabulary_sketched": _with(*TOKEN_CTES, select="SELECT term, tf FROM vocabulary"),
    "tfidf_idf": _with(
        *TOKEN_CTES, select="SELECT term, tf, df, round(idf, 6) AS idf FROM weights"
    ),
    "term_counts": _with(
        *TOKEN_CTES,
        select="""SELECT c.id, c.term, CAST(c.n AS INTEGER) AS n
FROM counts c JOIN vocabulary v ON v.term = c.term""",
    ),
    "tfidf_weights": _with(
        *TOKEN_CTES,
        """products AS (
  SELECT c.id, c.term, c.n * w.idf AS product FROM counts c JOIN weights w ON w.term = c.term)""",
        select="""SELECT id, term,
  round(product / sqrt(sum(product * product) OVER (PARTITION BY id)), 6) AS weight
FROM products""",
    ),
    "balanced_class_weights": _with(
        JIGSAW,
        PREPARED,
        select="""SELECT is_toxic AS label, count(*) AS n,
  CAST((SELECT count(*) FROM prepared) AS DOUBLE) / (2 * CAST(count(*) AS DOUBLE)) AS weight
FROM prepared GROUP BY is_toxic""",
    ),
    "batch_scores": _prepared(f"id, round({_sigmoid(LENGTH_LOGIT)}, 6) AS score"),
    "resumed_scores": _prepared(f"id, round({_sigmoid(LENGTH_LOGIT)}, 6) AS score"),
    "batch_bias_metrics": _stub_bias("length", LENGTH_LOGIT),
    "zero_shot_scores": _prepared(f"id, round({_sigmoid(YES_NO_LOGIT)}, 6) AS score"),
    "zero_shot_bias_metrics": _stub_bias("yes-no", YES_NO_LOGIT),
    "csv_comments_roundtrip": _prepared("*"),
    "csv_quarantine": _with(
        JIGSAW,
        select="""SELECT id, 'target' AS "column", 'high' AS value FROM jigsaw WHERE id % 29 = 5
UNION ALL
SELECT id, 'asian', '0,5 "or so"' FROM jigsaw WHERE id % 31 = 7
UNION ALL
SELECT id, 'target', CASE WHEN id % 29 <> 3 THEN CAST(target AS VARCHAR) END
FROM jigsaw WHERE id % 29 <> 5 AND id % 31 <> 7""",
    ),
    "ood_source_fallback": _with(
        TOXIGEN,
        select="""SELECT id, CASE WHEN toxicity_human > 3 THEN 1 ELSE 0 END AS label,
  md5(generation) AS digest FROM toxigen""",
    ),
    "saved_splits_roundtrip": _split(
        f"""SELECT p.* EXCLUDE (comment_text),
  CASE WHEN position < {TRAIN_ROWS} THEN 'train' ELSE 'eval' END AS split
FROM shuffled s JOIN prepared p ON s.id = p.id"""
    ),
    "predictions_roundtrip": _with(
        *PREDICTION_CTES, select="SELECT id, score, dataset, model FROM all_predictions"
    ),
    "metric_files_roundtrip": _with(
        *BIAS_CTES,
        select="""SELECT model, CAST(ord AS BIGINT) AS ord, identity, total_examples, """
        + ", ".join(METRIC_COLUMNS)
        + " FROM bias",
    ),
}
