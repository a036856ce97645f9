"""DuckDB/ANSI SQL text for the derived inputs and shared expressions.

These are the *oracle* side: an independent SQL statement of each derived
view and expression, used to check the DataFrame implementation. Tables
(``documents``, ``events``, ...) are registered views in the checker.
"""

from __future__ import annotations

from .. import vocab
from ..sources.views import RARE_LABELS


def lit(s: str) -> str:
    """SQL string literal; newlines become ``chr(10)`` concatenations."""
    parts = s.split("\n")
    quoted = ["'" + p.replace("'", "''") + "'" for p in parts]
    return " || chr(10) || ".join(quoted) if len(parts) > 1 else quoted[0]


def list_lit(items) -> str:
    return "[" + ", ".join(lit(x) for x in items) + "]"


DIMS = list_lit(vocab.DIMENSIONS)
VOCAB = list_lit(vocab.LABELS)


WS_SQL = " || ".join(f"chr({ord(c)})" for c in vocab.WHITESPACE)
BLANK = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in vocab.WHITESPACE) + "]"


def ustrip(e: str) -> str:
    return f"trim({e}, {WS_SQL})"


def extract_score(e: str) -> str:
    whens = []
    for pat in vocab.SCORE_PATTERNS:
        rx = lit("(?i)" + pat.replace(r"\s", BLANK).replace(r"\d", "[0-9]"))
        d = f"regexp_extract({e}, {rx}, 1)"
        whens.append(f"WHEN {d} <> '' THEN coalesce(TRY_CAST({d} AS INTEGER), {vocab.NO_SCORE})")
    return "(CASE " + " ".join(whens) + f" ELSE {vocab.NO_SCORE} END)"


def label_string(k: str) -> str:
    k = f"({k})"
    none_of = f"({k} % 5 <> 0 AND {k} % 7 <> 0 AND {k} % 11 <> 0)"
    return (f"concat_ws(';', CASE WHEN {k} % 5 = 0 THEN ' Vague' END, "
            f"CASE WHEN {k} % 7 = 0 THEN 'Off Topic ' END, "
            f"CASE WHEN {k} % 11 = 0 THEN 'Factual Error' END, "
            f"CASE WHEN {k} % 13 = 0 THEN 'Bogus Label' END, "
            f"CASE WHEN {k} % 17 = 0 THEN '' END, "
            f"CASE WHEN {none_of} THEN 'No Error' END"
            + "".join(f", CASE WHEN {k} % {n} = 0 THEN {lit(text)} END" for n, text in RARE_LABELS) + ")")


def parse_labels_raw(e: str) -> str:
    return f"list_transform(string_split({e}, ';'), lambda x: {ustrip('x')})"


def parse_labels(e: str) -> str:
    alias = " ".join(f"WHEN x = {lit(k)} THEN {lit(v)}" for k, v in vocab.LABEL_ALIASES.items())
    canon = f"list_transform({parse_labels_raw(e)}, lambda x: CASE {alias} ELSE x END)"
    return f"list_filter({canon}, lambda x: list_contains({VOCAB}, x))"


def binarize(e: str) -> str:
    return f"(CASE WHEN {e} IS NOT NULL THEN list_transform({VOCAB}, lambda v: CAST(list_contains({e}, v) AS INTEGER)) END)"


def md5_u32(seed, *keys: str) -> str:
    text = " || '|' || ".join([lit(str(seed))] + [f"CAST({k} AS VARCHAR)" for k in keys])
    return f"CAST(('0x' || substr(md5({text}), 1, 8)) AS BIGINT)"


RESP = f"""resp AS (
  SELECT event_id AS item_id,
         {DIMS}[event_id % 7 + 1] AS dimension,
         'm' || CAST(user_id % 3 AS VARCHAR) AS model,
         CASE WHEN event_id // 5 % 12 = 7 THEN 'score:' || chr(160) || CAST(event_id % 3 + 1 AS VARCHAR)
              WHEN event_id // 5 % 12 = 8 THEN 'Score' || chr(12288) || ': ' || CAST(event_id % 3 + 1 AS VARCHAR) || '.5 of 3'
              WHEN event_id // 5 % 12 = 9 THEN 'score: 99999999999'
              WHEN event_id // 5 % 12 = 10 THEN 'SCORE : ' || CAST(event_id % 3 + 1 AS VARCHAR) || ' not score: 9'
         ELSE CASE event_id % 5
           WHEN 0 THEN 'score: ' || CAST(event_id % 3 + 1 AS VARCHAR) || '  ' || chr(10) || 'reason: x'
           WHEN 1 THEN 'A Score of ' || CAST(event_id % 3 + 1 AS VARCHAR)
           WHEN 2 THEN 'Assign a Score:' || chr(10) || 'Score ' || CAST(event_id % 3 + 1 AS VARCHAR) || ': ok'
           WHEN 3 THEN '**Score:** ' || CAST(event_id % 3 + 1 AS VARCHAR)
           ELSE '' END END AS response,
         CAST(CASE WHEN event_id % 4 = 0 THEN floor(value) % 3 + 1 ELSE event_id % 3 + 1 END AS DOUBLE) AS rating
  FROM events)"""

SCORED = f"""scored AS (
  SELECT item_id, dimension, model, response, rating, {extract_score('response')} AS score FROM resp)"""

QA = """qa AS (
  SELECT u.conv_id * 100 + u.turn AS item_id, d.text AS passage, u.text AS question,
         a.text AS answer, d.source AS source, u.conv_id AS doc_id
  FROM conversations u
  JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  JOIN documents d ON d.doc_id = u.conv_id
  WHERE u.role = 'user')"""

LAB = f"""lab AS (
  SELECT doc_id AS item_id, CASE WHEN doc_id % 19 <> 0 THEN {label_string('doc_id')} END AS error_label
  FROM documents)"""

SEED = """seed AS (
  SELECT qa.*, lab.error_label FROM qa JOIN lab ON lab.item_id = qa.doc_id
  WHERE lab.error_label IS NOT NULL)"""

REV = f"""rev AS (
  SELECT doc_id AS item_id, {label_string('doc_id')} AS error_label,
         CASE WHEN doc_id % 11 <> 0 THEN CAST((doc_id * 37) % 101 AS DOUBLE) / 100.0 END AS "check-gemini",
         CAST((doc_id * 53 + 20) % 101 AS DOUBLE) / 100.0 AS "check-gpt",
         CAST((doc_id * 71 + 40) % 101 AS DOUBLE) / 100.0 AS "check-claude"
  FROM documents)"""

LOGIT = f"""logit AS (
  SELECT vec_id AS item_id,
         list_transform(embedding[1:{len(vocab.LABELS)}], lambda x: CAST(x AS DOUBLE) * 20.0) AS logits,
         [{VOCAB}[label + 1], {VOCAB}[CAST((label + vec_id % 3) % 11 AS INTEGER) + 1]] AS true_labels
  FROM embeddings)"""

BIN = """bin AS (
  SELECT doc_id AS item_id, CAST(quality AS INTEGER) AS label, CAST(toxic AS INTEGER) AS pred FROM labels)"""


def with_views(*views: str) -> str:
    return "WITH " + ",\n".join(views) + "\n"


def desc_case(x: str) -> str:
    """SQL CASE mapping a label to its evidence line (NULL if unknown)."""
    whens = " ".join(f"WHEN {lit(lab)} THEN {lit(vocab.describe_label_line(lab))}"
                     for lab in vocab.LABELS)
    return f"(CASE {x} {whens} END)"


def relevant_case(dim: str) -> str:
    whens = " ".join(f"WHEN {lit(d)} THEN {list_lit(labs)}"
                     for d, labs in vocab.DIMENSION_LABELS.items())
    return f"(CASE {dim} {whens} END)"


def relevant(labels_expr: str, dim: str) -> str:
    return f"list_filter({parse_labels(labels_expr)}, lambda x: list_contains({relevant_case(dim)}, x))"


def describe(arr: str) -> str:
    return (f"array_to_string(list_filter(list_transform({arr}, lambda x: {desc_case('x')}), "
            f"lambda x: x IS NOT NULL), chr(10))")


def sigmoid_list(e: str) -> str:
    return f"list_transform({e}, lambda x: 1.0 / (1.0 + exp(-x)))"


def decode(ind: str) -> str:
    return (f"array_to_string(list_filter(list_transform(range(0, {len(vocab.LABELS)}), "
            f"lambda i: CASE WHEN {ind}[i + 1] = 1 THEN {VOCAB}[i + 1] END), "
            f"lambda x: x IS NOT NULL), '; ')")


def templates_values(rows) -> str:
    vals = ", ".join(f"({lit(k)}, {lit(d)}, {lit(b)})" for k, d, b in rows)
    return f"tpl(kind, dimension, body) AS (VALUES {vals})"


def fill(template: str, slots) -> str:
    out = template
    for name, val in slots:
        out = f"replace({out}, {lit(name)}, {val})"
    return out


QA_DIM = f"""qad AS (SELECT qa.*, unnest({DIMS}) AS dimension FROM qa)"""

QA_LAB = f"""qal AS (
  SELECT qa.*, coalesce(lab.error_label, '') AS error_label
  FROM qa LEFT JOIN lab ON lab.item_id = qa.doc_id)"""
