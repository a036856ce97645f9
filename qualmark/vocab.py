"""Vocabulary, dimensions and default parameters.

Everything between the FIXED VALUES markers must stay equal to the published
evaluation scheme for results to line up (label names and their order, the
dimension names, which labels are relevant to which dimension, the default
sampling factors, the reviewer thresholds, the score patterns and the chat
markers). The label descriptions are our own wording.

The small vocabulary tables built here are bounded by the vocabulary (11 labels,
7 dimensions), so broadcasting them is always safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- FIXED VALUES (must equal the evaluation scheme) -----------------------

# Error labels, in vector order (indicator/probability position = list index).
LABELS = [
    "Incomplete",
    "Not A Question",
    "Spell Error",
    "Grammar Error",
    "Vague",
    "Unnecessary Copy from Passage",
    "Off Topic",
    "Factual Error",
    "Information Not Mentioned",
    "Off Target Answer",
    "No Error",
]

# Quality dimensions, each with the labels relevant to it (in this order).
DIMENSION_LABELS = {
    "fluency": ["Incomplete", "Spell Error", "Grammar Error", "No Error"],
    "clarity": ["Incomplete", "Not A Question", "Grammar Error", "Vague", "No Error"],
    "conciseness": ["Unnecessary Copy from Passage", "No Error"],
    "relevance": ["Off Topic", "No Error"],
    "consistency": ["Off Topic", "Factual Error", "Information Not Mentioned", "No Error"],
    "answerability": ["Incomplete", "Not A Question", "Vague", "Off Topic",
                      "Factual Error", "Information Not Mentioned", "No Error"],
    "answer_consistency": ["Incomplete", "Not A Question", "Vague", "Off Topic",
                           "Factual Error", "Information Not Mentioned",
                           "Off Target Answer", "No Error"],
}
DIMENSIONS = list(DIMENSION_LABELS)

# Older label spelling accepted at parse time.
LABEL_ALIASES = {"Grammatical Error": "Grammar Error"}

# Default label-sampling factors.
DEFAULT_DIFFICULTY = {
    "Factual Error": 1.4,
    "Information Not Mentioned": 1.4,
    "Grammar Error": 1.2,
    "Off Target Answer": 1.4,
    "Vague": 1.6,
    "Not A Question": 1.2,
}
DEFAULT_IMPORTANCE = {
    "Factual Error": 1.4,
    "Off Target Answer": 1.4,
    "Information Not Mentioned": 1.4,
    "Vague": 1.4,
    "Not A Question": 1.2,
    "Incomplete": 1.0,
    "Spell Error": 0.8,
    "Off Topic": 0.6,
}
DEFAULT_MIN_BOOST = 1.2
DEFAULT_MAX_BOOST = 1.8

# Reviewer voting.
LOW_PRECISION_LABELS = ["Vague", "Factual Error", "Information Not Mentioned",
                        "Off Target Answer"]
DEFAULT_REVIEW_THRESHOLD = 0.8
LOW_PRECISION_THRESHOLD = 0.9
DEFAULT_VOTES = 2
LOW_PRECISION_VOTES = 3
REVIEWERS = ["gemini", "gpt", "claude"]

# Unparsed score sentinel.
NO_SCORE = 999

# The characters that str.strip() removes and a blank in a pattern matches.
WHITESPACE = "".join(map(chr, [*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203),
                               8232, 8233, 8239, 8287, 12288]))

# Score patterns, tried in this order, case-insensitive, leftmost match.
SCORE_PATTERNS = [
    r"(?:Score|score)\s*:\s*(\d+)",
    r"(?:Score|score) of\s*(\d+)",
    r"Assign a Score:?\s*(?:\n\s*)?Score\s+(\d+):.*",
]

# Separator between identifier/verifier text parts, by model family.
SEP_TOKENS = {"bert": "[SEP]", "deberta": "[SEP]", "roberta": "</s>"}
DEFAULT_SEP = "[SEP]"

# Chat transcript markers (one begin marker, then per message a header and an
# end marker; optional assistant cue at the end).
CHAT_BEGIN = "<|begin_of_text|>"
CHAT_HEADER_START = "<|start_header_id|>"
CHAT_HEADER_END = "<|end_header_id|>\n\n"
CHAT_TURN_END = "<|eot_id|>"

# Split seed and shares.
SPLIT_SEED = 42
IDENTIFIER_DEV_SHARE = 10  # percent
VERIFIER_DEV_SHARE = 20  # percent

# Candidate slice of the unlabeled pool.
CANDIDATE_SLICE = 20000

# Generation attempts per candidate.
GENERATION_ATTEMPTS = 3

# Identifier input cap and default decision threshold.
MAX_TOKENS = 512
DEFAULT_THRESHOLD = 0.5

# Focal loss defaults.
FOCAL_ALPHA = 0.25
FOCAL_GAMMA = 2.0

# ---- END FIXED VALUES --------------------------------------------------------

# Our own short description of each label (used as prompt evidence).
LABEL_DESCRIPTIONS = {
    "Incomplete": "the question stops before it is finished or lacks a needed part.",
    "Not A Question": "the text is a statement or fragment, not something asked.",
    "Spell Error": "one or more words are misspelled.",
    "Grammar Error": "word order, tense, agreement or other grammar is wrong.",
    "Vague": "the question is too broad or ambiguous to know what is asked.",
    "Unnecessary Copy from Passage": "long stretches of the passage are copied verbatim without need.",
    "Off Topic": "the question has nothing to do with what the passage is about.",
    "Factual Error": "the question states something the passage contradicts.",
    "Information Not Mentioned": "the question asks for something the passage never mentions.",
    "Off Target Answer": "the given answer does not answer this question.",
    "No Error": "no problem found; the question is clear, relevant and answerable.",
}


def describe_label_line(label: str) -> str:
    """Evidence line for one label, as spliced into prompts."""
    return f"* {label} -- {LABEL_DESCRIPTIONS[label]}"


SYSTEM_EVALUATOR = "You grade the quality of automatically generated questions."
SYSTEM_GENERATOR = ("You write training examples of flawed questions for an "
                    "error-identification model.")
SYSTEM_REVIEWER = "You check whether error labels given to a question are right."


# ---- Column helpers ----------------------------------------------------------

def vocab_array() -> Column:
    return F.array(*[F.lit(x) for x in LABELS])


def description_map() -> Column:
    """label -> evidence line, as a literal map (11 entries)."""
    return F.create_map(*[c for lab in LABELS
                          for c in (F.lit(lab), F.lit(describe_label_line(lab)))])


def alias_map() -> Column:
    return F.create_map(*[c for k, v in LABEL_ALIASES.items()
                          for c in (F.lit(k), F.lit(v))])


def relevant_labels_for(dim_col: Column) -> Column:
    """Array of labels relevant to the dimension in ``dim_col``."""
    m = F.create_map(*[c for d, labs in DIMENSION_LABELS.items()
                       for c in (F.lit(d), F.array(*[F.lit(x) for x in labs]))])
    return F.element_at(m, dim_col)


def factor_table(spark: SparkSession, difficulty: dict | None,
                 importance: dict | None) -> DataFrame:
    """``(label, difficulty, importance)`` for labels named in either dict."""
    difficulty = difficulty or {}
    importance = importance or {}
    names = sorted(set(difficulty) | set(importance))
    rows = [(n, difficulty.get(n), importance.get(n)) for n in names]
    schema = T.StructType([
        T.StructField("label", T.StringType(), False),
        T.StructField("difficulty", T.DoubleType(), True),
        T.StructField("importance", T.DoubleType(), True),
    ])
    return spark.createDataFrame(rows, schema)


def sep_token(model_type: str) -> str:
    return SEP_TOKENS.get((model_type or "").lower(), DEFAULT_SEP)
