"""Agreement and classification metrics as single-pass aggregations.

Every metric here is a declarative aggregate (sum/count/covariance), so Spark
runs a partial aggregate per task and shuffles only one small row per task
and group: a hot group (say a third of all rows on one dimension) costs no
more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions import losses


def safe_ratio(num: Column, den: Column) -> Column:
    """``num/den``, 0 when undefined (0/0 counts as 0)."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def f1_from_counts(tp: Column, fp: Column, fn: Column) -> Column:
    return safe_ratio(2 * tp, 2 * tp + fp + fn)


# ---- agreement with human ratings -------------------------------------------

def pearson(x: Column, y: Column) -> Column:
    """Pearson r as an aggregate; NULL (never an error) when a side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def pearson_by_group(df: DataFrame, keys: Sequence[str], x: str, y: str,
                     digits: int | None = 6, valid: Column | None = None) -> DataFrame:
    """``(keys..., n, pearson_r)`` over rows where both sides are non-NULL
    (and ``valid`` holds, if given).

    ``valid`` is applied inside the aggregate rather than as a Filter: a
    Filter on a computed column (e.g. a parsed score) would be pushed below
    the projection and evaluate the expression twice. Groups with no valid
    row are dropped after the (small) aggregate, as a Filter would."""
    xc, yc = F.col(x).cast("double"), F.col(y).cast("double")
    ok = xc.isNotNull() & yc.isNotNull()
    if valid is not None:
        ok = ok & valid
    xv, yv = F.when(ok, xc), F.when(ok, yc)
    r = pearson(xv, yv)
    if digits is not None:
        r = F.round(r, digits)
    out = df.groupBy(*keys).agg(F.count_if(ok).alias("n"), r.alias("pearson_r"))
    return out.filter(F.col("n") > 0)


def parse_rate(scored: DataFrame, keys: Sequence[str] = ("dimension", "model"),
               score: str = "score") -> DataFrame:
    """Share of responses without a score (999) per group."""
    unparsed = (F.col(score) == vocab.NO_SCORE).cast("int")
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(unparsed).cast("long").alias("n_unparsed"),
        F.round(F.avg(unparsed.cast("double")), 6).alias("unparsed_rate"),
    )


# ---- multi-label -------------------------------------------------------------

def _label_counts(df: DataFrame, y: str, p: str) -> DataFrame:
    """One row: tp/fp/fn/support per label (as arrays), exact matches, rows,
    and the per-row (samples) P/R/F1 sums. One pass, no explode."""
    n = len(vocab.LABELS)
    yc, pc = F.col(y), F.col(p)
    aggs = []
    for i in range(n):
        yi, pi = yc[i], pc[i]
        aggs += [F.sum(yi * pi).alias(f"tp{i}"), F.sum((1 - yi) * pi).alias(f"fp{i}"),
                 F.sum(yi * (1 - pi)).alias(f"fn{i}")]
    inter = F.aggregate(F.zip_with(yc, pc, lambda a, b: a * b), F.lit(0), lambda s, v: s + v)
    ny = F.aggregate(yc, F.lit(0), lambda s, v: s + v)
    npred = F.aggregate(pc, F.lit(0), lambda s, v: s + v)
    aggs += [
        F.count(F.lit(1)).alias("rows"),
        F.sum((yc == pc).cast("int")).alias("exact"),
        F.sum(safe_ratio(inter, npred)).alias("s_p"),
        F.sum(safe_ratio(inter, ny)).alias("s_r"),
        F.sum(safe_ratio(2 * inter, ny + npred)).alias("s_f"),
    ]
    return df.agg(*aggs)


def multilabel_metrics(df: DataFrame, y: str = "y_true", p: str = "y_pred",
                       digits: int = 6) -> DataFrame:
    """One row: subset accuracy, micro precision/recall/F1 and macro F1."""
    n = len(vocab.LABELS)
    c = _label_counts(df, y, p)
    tp = sum(F.coalesce(F.col(f"tp{i}"), F.lit(0)) for i in range(n))
    fp = sum(F.coalesce(F.col(f"fp{i}"), F.lit(0)) for i in range(n))
    fn = sum(F.coalesce(F.col(f"fn{i}"), F.lit(0)) for i in range(n))
    macro = sum(f1_from_counts(F.col(f"tp{i}"), F.col(f"fp{i}"), F.col(f"fn{i}"))
                for i in range(n)) / F.lit(float(n))
    return c.select(
        F.col("rows").cast("long").alias("n"),
        F.round(safe_ratio(F.col("exact"), F.col("rows")), digits).alias("accuracy"),
        F.round(safe_ratio(tp, tp + fp), digits).alias("micro_precision"),
        F.round(safe_ratio(tp, tp + fn), digits).alias("micro_recall"),
        F.round(f1_from_counts(tp, fp, fn), digits).alias("micro_f1"),
        F.round(F.coalesce(macro, F.lit(0.0)), digits).alias("macro_f1"),
    )


def multilabel_report(df: DataFrame, y: str = "y_true", p: str = "y_pred",
                      digits: int = 6) -> DataFrame:
    """Per-label precision/recall/F1/support plus micro, macro, weighted and
    samples averages (support of an average row = total support).

    All rows are built from the single aggregated row (one scan of the
    input); the per-label arithmetic uses array expressions on that row."""
    n = len(vocab.LABELS)
    c = _label_counts(df, y, p)
    arr = c.select(
        F.array(*[F.coalesce(F.col(f"tp{i}"), F.lit(0)).cast("long") for i in range(n)]).alias("tp"),
        F.array(*[F.coalesce(F.col(f"fp{i}"), F.lit(0)).cast("long") for i in range(n)]).alias("fp"),
        F.array(*[F.coalesce(F.col(f"fn{i}"), F.lit(0)).cast("long") for i in range(n)]).alias("fn"),
        "rows", "s_p", "s_r", "s_f")
    per = F.transform(F.arrays_zip("tp", "fp", "fn"), lambda e: F.struct(
        safe_ratio(e["tp"], e["tp"] + e["fp"]).alias("prec"),
        safe_ratio(e["tp"], e["tp"] + e["fn"]).alias("rec"),
        f1_from_counts(e["tp"], e["fp"], e["fn"]).alias("f1"),
        (e["tp"] + e["fn"]).alias("support")))
    x = arr.select("*", per.alias("per"))

    def total(col_arr, f=lambda v: v):
        return F.aggregate(col_arr, F.lit(0.0), lambda acc, v: acc + f(v).cast("double"))

    sup = F.aggregate(F.col("tp"), F.lit(0).cast("long"), lambda a, v: a + v) + \
        F.aggregate(F.col("fn"), F.lit(0).cast("long"), lambda a, v: a + v)
    t_tp = total(F.col("tp"))
    t_fp = total(F.col("fp"))
    t_fn = total(F.col("fn"))

    def mean(field):
        return total(F.col("per"), lambda e: e[field]) / F.lit(float(n))

    def weighted(field):
        return safe_ratio(total(F.col("per"), lambda e: e[field] * e["support"]), sup)

    def row(name, pr, rc, f, support):
        return F.struct(name.alias("row_label"), pr.alias("prec"), rc.alias("rec"),
                        f.alias("f1"), support.cast("long").alias("support"))

    names = F.array(*[F.lit(lab) for lab in vocab.LABELS])
    label_rows = F.transform(F.col("per"), lambda e, i: row(
        F.element_at(names, i + 1), e["prec"], e["rec"], e["f1"], e["support"]))
    avg_rows = F.array(
        row(F.lit("micro avg"), safe_ratio(t_tp, t_tp + t_fp), safe_ratio(t_tp, t_tp + t_fn),
            f1_from_counts(t_tp, t_fp, t_fn), sup),
        row(F.lit("macro avg"), mean("prec"), mean("rec"), mean("f1"), sup),
        row(F.lit("weighted avg"), weighted("prec"), weighted("rec"), weighted("f1"), sup),
        row(F.lit("samples avg"), safe_ratio(F.col("s_p"), F.col("rows")),
            safe_ratio(F.col("s_r"), F.col("rows")), safe_ratio(F.col("s_f"), F.col("rows")), sup),
    )
    return x.select(F.inline(F.concat(label_rows, avg_rows))).select(
        "row_label",
        F.round("prec", digits).alias("precision"),
        F.round("rec", digits).alias("recall"),
        F.round("f1", digits).alias("f1"),
        "support",
    )


# ---- binary ------------------------------------------------------------------

def _binary_counts(df: DataFrame, y: str, p: str) -> DataFrame:
    yc, pc = F.col(y), F.col(p)
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((yc == 1) & (pc == 1)).alias("tp"),
        F.count_if((yc == 0) & (pc == 1)).alias("fp"),
        F.count_if((yc == 1) & (pc == 0)).alias("fn"),
        F.count_if((yc == 0) & (pc == 0)).alias("tn"),
    )


def binary_metrics(df: DataFrame, y: str = "label", p: str = "pred",
                   digits: int = 6) -> DataFrame:
    """accuracy, precision, recall, F1 with class 1 positive."""
    c = _binary_counts(df, y, p)
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    return c.select(
        F.col("n").cast("long").alias("n"),
        F.round(safe_ratio(tp + tn, F.col("n")), digits).alias("accuracy"),
        F.round(safe_ratio(tp, tp + fp), digits).alias("precision"),
        F.round(safe_ratio(tp, tp + fn), digits).alias("recall"),
        F.round(f1_from_counts(tp, fp, fn), digits).alias("f1"),
    )


def binary_report(df: DataFrame, y: str = "label", p: str = "pred",
                  digits: int = 6) -> DataFrame:
    """Per-class (0, 1) rows, an accuracy row, macro and weighted averages."""
    c = _binary_counts(df, y, p)
    tp, fp, fn, tn, n = (F.col(k) for k in ("tp", "fp", "fn", "tn", "n"))
    # class 1: positives as is; class 0: roles of the two classes swapped
    p1, r1, f1_1 = safe_ratio(tp, tp + fp), safe_ratio(tp, tp + fn), f1_from_counts(tp, fp, fn)
    p0, r0, f1_0 = safe_ratio(tn, tn + fn), safe_ratio(tn, tn + fp), f1_from_counts(tn, fn, fp)
    s1, s0 = tp + fn, tn + fp
    acc = safe_ratio(tp + tn, n)

    def row(name, pr, rc, f, s):
        return F.struct(F.lit(name).alias("row_label"), pr.alias("prec"), rc.alias("rec"),
                        f.alias("f1"), s.cast("long").alias("support"))

    arr = F.array(
        row("0", p0, r0, f1_0, s0),
        row("1", p1, r1, f1_1, s1),
        row("accuracy", F.lit(None).cast("double"), F.lit(None).cast("double"), acc, n),
        row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f1_0 + f1_1) / 2, n),
        row("weighted avg", safe_ratio(p0 * s0 + p1 * s1, n), safe_ratio(r0 * s0 + r1 * s1, n),
            safe_ratio(f1_0 * s0 + f1_1 * s1, n), n),
    )
    return c.select(F.inline(arr)).select(
        "row_label", F.round("prec", digits).alias("precision"),
        F.round("rec", digits).alias("recall"), F.round("f1", digits).alias("f1"), "support")


# ---- losses ------------------------------------------------------------------

def _elementwise_sum(logit_col: str, target_col: str, fn) -> Column:
    pairs = F.zip_with(F.col(logit_col), F.col(target_col),
                       lambda x, t: fn(x, t.cast("double")))
    return F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v)


def bce_loss(df: DataFrame, logits: str = "logits", targets: str = "y_true",
             pos_weight: Sequence[float] | None = None, digits: int = 6) -> DataFrame:
    """Mean (and sum) sigmoid cross-entropy over all row x label elements."""
    if pos_weight is None:
        per_row = _elementwise_sum(logits, targets, losses.bce_with_logits)
    else:
        w = F.array(*[F.lit(float(v)) for v in pos_weight])
        trip = F.arrays_zip(F.col(logits).alias("x"), F.col(targets).alias("t"), w.alias("w"))
        per_row = F.aggregate(
            F.transform(trip, lambda e: losses.bce_with_logits(
                e["x"], e["t"].cast("double"), e["w"])),
            F.lit(0.0), lambda s, v: s + v)
    agg = df.agg(F.sum(per_row).alias("total"), F.sum(F.size(F.col(logits))).alias("cells"),
                 F.count(F.lit(1)).alias("n"))
    return agg.select(F.col("n").cast("long").alias("n"),
                      F.round(safe_ratio(F.col("total"), F.col("cells")), digits).alias("bce_mean"),
                      F.round(F.col("total"), digits).alias("bce_sum"))


def focal_loss(df: DataFrame, logits: str = "logits", targets: str = "y_true",
               alpha: float = vocab.FOCAL_ALPHA, gamma: float = vocab.FOCAL_GAMMA,
               reduction: str = "mean", digits: int = 6) -> DataFrame:
    """Focal loss with reduction ``mean`` / ``sum`` (one row) or ``none``
    (per-row array of element losses)."""
    def el(x, t):
        return losses.focal(x, t, alpha, gamma)
    if reduction == "none":
        return df.withColumn("focal", F.zip_with(F.col(logits), F.col(targets),
                                                 lambda x, t: el(x, t.cast("double"))))
    if reduction not in ("mean", "sum"):
        raise ValueError("reduction must be 'mean', 'sum' or 'none'")
    per_row = _elementwise_sum(logits, targets, el)
    agg = df.agg(F.sum(per_row).alias("total"), F.sum(F.size(F.col(logits))).alias("cells"),
                 F.count(F.lit(1)).alias("n"))
    return agg.select(F.col("n").cast("long").alias("n"),
                      F.round(safe_ratio(F.col("total"), F.col("cells")), digits).alias("focal_mean"),
                      F.round(F.col("total"), digits).alias("focal_sum"))


def best_thresholds(df: DataFrame, probs: str = "probs", y: str = "y_true", steps: int = 1000,
                    digits: int = 6) -> DataFrame:
    """The cutoff k / ``steps`` with the best F1 for each label (the lowest of equal
    ones): ``label``, ``threshold``, ``f1``, ``support``.

    One pass makes a histogram of probabilities by label and truth (at most
    ``steps`` + 1 bins a label, merged by partial aggregates); every cutoff is
    judged on it. A probability counts as positive above the cutoff."""
    n = len(vocab.LABELS)
    pairs = F.arrays_zip(F.col(probs).alias("p"), F.col(y).alias("t"))
    x = df.select(F.posexplode(pairs).alias("idx", "v")).select(
        "idx", F.ceil(F.col("v.p") * steps).cast("int").alias("bin"), F.col("v.t").alias("t"))
    bins = x.groupBy("idx", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("pos"))
    below = Window.partitionBy("idx").orderBy("bin")
    above = Window.partitionBy("idx").orderBy(F.desc("bin"))
    support = F.sum("pos").over(Window.partitionBy("idx"))
    tp, found = F.sum("pos").over(above), F.sum("n").over(above)
    # the lowest cutoff that takes this bin and all above it: the next bin below
    cuts = bins.select("idx", "bin", F.coalesce(F.lag("bin").over(below), F.lit(0)).alias("cut"),
                       support.alias("support"), safe_ratio(2 * tp, found + support).alias("f1"))
    best = cuts.groupBy("idx").agg(
        F.max(F.when(F.col("bin") > 0, F.struct("f1", (-F.col("cut")).alias("cut")))).alias("b"),
        F.max("support").alias("support"))
    names = F.array(*[F.lit(v) for v in vocab.LABELS])
    return best.filter(F.col("idx") < n).select(
        F.element_at(names, F.col("idx") + 1).alias("label"),
        F.coalesce(-F.col("b.cut") / F.lit(float(steps)), F.lit(0.0)).alias("threshold"),
        F.round(F.coalesce("b.f1", F.lit(0.0)), digits).alias("f1"), F.col("support").cast("long").alias("support"))


def threshold_list(best: DataFrame) -> list[float]:
    """The thresholds of ``best_thresholds`` in vocabulary order (0.5 where there is
    no label), as ``identify_errors`` takes them; eleven numbers."""
    found = {r["label"]: r["threshold"] for r in best.collect()}
    return [found.get(name, vocab.DEFAULT_THRESHOLD) for name in vocab.LABELS]
