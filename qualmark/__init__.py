"""qualmark: question-quality evaluation as Spark DataFrame jobs.

Rows are (passage, question, answer) triples keyed by ``item_id``. The package
labels them with error types, renders per-dimension prompts, parses evaluator
responses into scores, and compares scores with human ratings, all with
DataFrame/SQL expressions so Catalyst plans the work.
"""

__version__ = "0.1.0"
