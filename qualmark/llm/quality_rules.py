"""Quality rules with risk-controlled cutoffs.

Every rule rejects a document if one of its measures reaches a cutoff. Cutoffs
are chosen per stratum so that, with confidence ``1 - DELTA`` over all strata at
once, at most ``RISK`` of the good documents of the stratum are rejected:

* labelled good documents are dealt into two halves. The tuning half gives, for
  each strictness in ``PATH``, the cutoff of every rule that this share of its
  good documents reaches;
* on the holdout half the strictnesses are tested in rising order. One passes if
  the exact (Clopper-Pearson) upper bound for the rate of documents rejected by
  any rule is at most ``RISK``; the first that fails ends the sequence, so the
  order needs no correction. The bound's level is ``DELTA`` divided by the
  number of strata (Bonferroni).

A stratum with too few labelled documents gets no cutoffs: only the base rules
act there.

Defined results: NULL text has no words and fails the base rules. A NULL stratum
is a stratum of its own. Labels of unknown documents and NULL labels are not
used. Rows are judged one by one, repeated or not.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import map_rows, materialize

RISK = 0.02
DELTA = 0.05
PATH = (0.0, 0.0005, 0.001, 0.002, 0.003, 0.004, 0.006, 0.008, 0.01, 0.015, 0.02)
RULES = ("symbols", "repeated lines", "repeated words", "capitals", "long words", "short words", "exclamations")
#: Measures are whole numbers from 0 to this.
SCALE = 1000
_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


def repeated_words(ws: list) -> int:
    """Words inside 3-word windows that occur at least twice."""
    if len(ws) < 4:
        return 0
    number: dict = {}
    ids = np.array([number.setdefault(w, len(number)) for w in ws], np.int64)
    base = len(number)
    window = (ids[:-2] * base + ids[1:-1]) * base + ids[2:] if base < 1 << 20 else None
    if window is None:
        pair = np.unique(ids[:-1] * base + ids[1:], return_inverse=True)[1]
        window = pair[:-1] * base + ids[2:]
    _, at, n = np.unique(window, return_inverse=True, return_counts=True)
    twice = n[at] > 1
    inside = np.zeros(len(ws), bool)
    for j in range(3):
        inside[j:len(twice) + j] |= twice
    return int(inside.sum())


def measure(text: str | None) -> tuple:
    """Base counts and the measures of ``RULES``."""
    text = text or ""
    ws = text.encode().split()
    chars = len(text) - sum(map(text.count, _SPACES))
    symbols = sum(map(text.count, _SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    again = len(lines) - len(set(lines))
    repeats = repeated_words(ws)
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    capitals = int((((code >= 65) & (code <= 90)) | ((code >= 192) & (code <= 222))).sum())
    length = chars / max(1, len(ws))
    share = [symbols / max(1, chars), again / max(1, len(lines)), repeats / max(1, len(ws)),
             capitals / max(1, chars), length / 20, 1 - length / 20, text.count("!") / max(1, len(ws))]
    return (len(ws), chars, symbols, again, repeats,
            [int(SCALE * min(1.0, max(0.0, x))) for x in share])


def measures(docs: DataFrame, stratum: str) -> DataFrame:
    def make():
        def one(doc_id, text, kind):
            yield doc_id, kind, *measure(text)
        return one

    return map_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"),
                                F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum")),
                    make, "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, "
                          "n_dup_lines long, n_repeat_words long, m array<int>") \
        .withColumn("base_failed", (F.col("n_words") < 50)
                    | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def upper_bound(k: int, n: int, level: float) -> float:
    """Exact upper confidence bound of a binomial rate: the rate at which at
    most ``k`` of ``n`` has probability ``level``."""
    if k >= n:
        return 1.0

    def tail(p: float) -> float:
        if p <= 0:
            return 1.0
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1)
                + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
        top = max(logs)
        return math.exp(top) * sum(math.exp(x - top) for x in logs)

    lo, hi = k / n, 1.0 - 1e-15
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if tail(mid) > level else (lo, mid)
    return hi


def choose(rejected: list[int], n: int, risk: float, level: float) -> int:
    """Steps of the path that pass, tested in order until one fails."""
    steps = 0
    while n and steps < len(rejected) and upper_bound(rejected[steps], n, level) <= risk:
        steps += 1
    return steps


def _first_reached(m: str, cuts: str) -> F.Column:
    """The first strictness at which a measure reaches its cutoff; -1 if none."""
    return F.expr(f"""array_position(transform({cuts}, c ->
        exists(sequence(0, {len(RULES) - 1}), r -> element_at({m}, r + 1) >= element_at(c, r + 1))), true) - 1""")


def thresholds(measured: DataFrame, labels: DataFrame, risk: float = RISK,
               delta: float = DELTA, path: tuple[float, ...] = PATH) -> DataFrame:
    """stratum, cuts (one cutoff per rule), strictness, n and rejected of the
    holdout, bound; strata without a passing strictness are left out."""
    good = labels.filter("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id").distinct()
    labelled = materialize(
        measured.filter("not base_failed").join(good, "doc_id")
        .select("stratum", "m", (F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0).alias("tuning")), "labelled")

    def cut():
        def one(stratum, counts):
            out = np.full((len(path), len(RULES)), SCALE + 1)
            n = np.zeros((len(RULES), SCALE + 2), np.int64)
            for c in counts:
                n[c["rule"], c["bin"]] = c["n"]
            for rule in range(len(RULES)):
                reach = n[rule, ::-1].cumsum()[::-1] / max(1, n[rule].sum())
                for i, share in enumerate(path):
                    out[i, rule] = int(np.argmax(reach <= share))
            yield stratum, out.tolist()
        return one

    bins = (labelled.filter("tuning").select("stratum", F.posexplode("m").alias("rule", "bin"))
            .groupBy("stratum", "rule", "bin").agg(F.count("*").alias("n")))
    by_stratum = bins.groupBy("stratum").agg(F.collect_list(F.struct("rule", "bin", "n")))
    paths = materialize(map_rows(by_stratum, cut, "stratum string, paths array<array<int>>"), "paths")
    strata = max(1, paths.count())
    tested = (labelled.filter("not tuning").join(paths, "stratum")
              .select("stratum", _first_reached("m", "paths").alias("step"))
              .groupBy("stratum", "step").agg(F.count("*").alias("n")))

    def test():
        def one(stratum, counts):
            n = sum(c["n"] for c in counts)
            rejected = [sum(c["n"] for c in counts if 0 <= c["step"] <= i) for i in range(len(path))]
            steps = choose(rejected, n, risk, delta / strata)
            if steps:
                k = rejected[steps - 1]
                yield stratum, steps - 1, n, k, upper_bound(k, n, delta / strata)
        return one

    passed = map_rows(tested.groupBy("stratum").agg(F.collect_list(F.struct("step", "n"))), test,
                      "stratum string, step int, n long, rejected long, bound double")
    strictness = F.element_at(F.array(*map(F.lit, path)), F.col("step") + 1)
    return passed.join(paths, "stratum").select(
        "stratum", F.element_at("paths", F.col("step") + 1).alias("cuts"), strictness.alias("strictness"),
        "n", "rejected", "bound")


def apply_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """Base counts, base_failed, kept, and the first rule that rejects."""
    measured = materialize(measures(docs, stratum), "measures")
    chosen = thresholds(measured, labels).select("stratum", "cuts")
    reached = F.expr(f"""array_position(transform(sequence(1, {len(RULES)}), r ->
        element_at(m, r) >= element_at(cuts, r)), true)""")
    judged = measured.join(chosen, "stratum", "left").withColumn(
        "rule", F.when(F.col("cuts").isNotNull() & (reached > 0),
                       F.element_at(F.array(*map(F.lit, RULES)), reached.cast("int"))))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule")
