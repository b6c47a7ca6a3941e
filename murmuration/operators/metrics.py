"""Metrics as one-row (or per-class) tables: one or two aggregates each, never a collect.

Columns are named by the caller. Rows enter as (truth, prediction) or (truth, score); weights are optional.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import percentiles, running


def everything():
    """The window over all rows of a small table."""
    return Window.partitionBy()


def confusion(df: DataFrame, y: str, p: str, weight: Column | None = None) -> DataFrame:
    """(y, p, n) for the pairs that occur."""
    w = F.lit(1) if weight is None else weight
    return df.groupBy(F.col(y).alias("y"), F.col(p).alias("p")).agg(F.sum(w).alias("n"))


def accuracy(df: DataFrame, y: str, p: str, weight: Column | None = None) -> DataFrame:
    w = F.lit(1.0) if weight is None else weight
    return df.agg((F.sum(w * (F.col(y) == F.col(p)).cast("double")) / F.sum(w)).alias("accuracy"))


def per_class(df: DataFrame, y: str, p: str) -> DataFrame:
    """label, tp, fp, fn, support, precision, recall, f1 over the union of labels; 0 where undefined."""
    c = confusion(df, y, p)
    sides = c.select(
        F.explode(
            F.array(
                F.struct(F.col("y").alias("label"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("tp"),
                         F.when(F.col("y") != F.col("p"), F.col("n")).otherwise(0).alias("fn"), F.lit(0).cast("long").alias("fp")),
                F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fn"),
                         F.when(F.col("y") != F.col("p"), F.col("n")).otherwise(0).alias("fp")),
            )
        ).alias("e")
    ).select("e.*")
    g = sides.groupBy("label").agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn")])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return g.select(
        "label", "tp", "fp", "fn", (tp + fn).alias("support"), ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def averaged(df: DataFrame, y: str, p: str) -> DataFrame:
    """average, precision, recall, f1: macro, micro, weighted and binary (the greater label is positive)."""
    c = per_class(df, y, p)
    names = ("precision", "recall", "f1")
    macro = c.agg(*[F.avg(n).alias(n) for n in names]).select(F.lit("macro").alias("average"), *names)
    weighted = c.agg(*[(F.sum(F.col(n) * F.col("support")) / F.sum("support")).alias(n) for n in names]).select(F.lit("weighted").alias("average"), *names)
    s = {x: F.sum(x) for x in ("tp", "fp", "fn")}
    micro = c.agg(
        (s["tp"] / (s["tp"] + s["fp"])).alias("precision"), (s["tp"] / (s["tp"] + s["fn"])).alias("recall"),
        (2 * s["tp"] / (2 * s["tp"] + s["fp"] + s["fn"])).alias("f1"),
    ).select(F.lit("micro").alias("average"), *names)
    binary = c.agg(*[F.max_by(n, "label").alias(n) for n in names]).select(F.lit("binary").alias("average"), *names)
    return macro.unionByName(weighted).unionByName(micro).unionByName(binary)


def balanced_accuracy(df: DataFrame, y: str, p: str) -> DataFrame:
    return per_class(df, y, p).where("support > 0").agg(F.avg("recall").alias("balanced_accuracy"))


def cohen_kappa(df: DataFrame, y: str, p: str) -> DataFrame:
    c = _margins(confusion(df, y, p))
    return c.agg(
        (F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)) / F.max("total")).alias("po"),
        # Each diagonal cell that could occur: rows of the margins' join, counted once per label below.
        F.max("total").alias("total"),
    ).crossJoin(_chance(confusion(df, y, p))).select(((F.col("po") - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"))


def _chance(c: DataFrame) -> DataFrame:
    rows = c.groupBy(F.col("y").alias("label")).agg(F.sum("n").alias("a"))
    cols = c.groupBy(F.col("p").alias("label2")).agg(F.sum("n").alias("b"))
    both = rows.join(cols, F.col("label") == F.col("label2"))
    n = c.agg(F.sum("n").alias("n_all"))
    return both.agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("ab")).crossJoin(n).select((F.col("ab") / (F.col("n_all") * F.col("n_all"))).alias("pe"))


def _margins(c: DataFrame) -> DataFrame:
    return c.withColumns({
        "a": F.sum("n").over(Window.partitionBy("y")), "b": F.sum("n").over(Window.partitionBy("p")), "total": F.sum("n").over(everything()),
    })


def matthews(df: DataFrame, y: str, p: str) -> DataFrame:
    """The multiclass correlation coefficient, 0 where undefined."""
    c = per_class(df, y, p).select((F.col("tp") + F.col("fn")).cast("double").alias("t"), (F.col("tp") + F.col("fp")).cast("double").alias("q"), F.col("tp").cast("double").alias("tp"))
    m = c.agg(F.sum("tp").alias("c"), F.sum("t").alias("s"), F.sum(F.col("t") * F.col("q")).alias("tq"), F.sum(F.col("q") * F.col("q")).alias("qq"), F.sum(F.col("t") * F.col("t")).alias("tt"))
    under = F.sqrt((F.col("s") ** 2 - F.col("qq")) * (F.col("s") ** 2 - F.col("tt")))
    return m.select(F.when(under == 0, 0.0).otherwise((F.col("c") * F.col("s") - F.col("tq")) / under).alias("mcc"))


def log_loss(df: DataFrame, y: str, p: str, eps: float = 1e-15) -> DataFrame:
    """Binary cross entropy of the probability of class 1."""
    q = F.least(F.greatest(F.col(p), F.lit(eps)), F.lit(1 - eps))
    return df.agg((-F.avg(F.when(F.col(y) == 1, F.ln(q)).otherwise(F.ln(1 - q)))).alias("log_loss"))


def brier(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.agg(F.avg((F.col(p) - F.col(y)) ** 2).alias("brier"))


def hinge(df: DataFrame, y: str, d: str) -> DataFrame:
    """Labels 0/1, decisions signed."""
    return df.agg(F.avg(F.greatest(F.lit(0.0), 1 - (2 * F.col(y) - 1) * F.col(d))).alias("hinge"))


def score_steps(df: DataFrame, y: str, s: str) -> DataFrame:
    """Distinct scores from the top, with cumulative true and false positives: the steps of ROC and PR curves.

    Rows are first counted per score, so the ordered sums see one row for each distinct score.
    """
    g = df.groupBy(F.col(s).alias("threshold")).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.sum(1 - F.col(y).cast("long")).alias("neg"))
    return running(g, [-F.col("threshold")], {"tp": "pos", "fp": "neg"}, totals=True)


def roc_curve(df: DataFrame, y: str, s: str) -> DataFrame:
    steps = score_steps(df, y, s)
    return steps.select("threshold", (F.col("tp") / F.col("tp_all")).alias("tpr"), (F.col("fp") / F.col("fp_all")).alias("fpr"))


def roc_auc(df: DataFrame, y: str, s: str) -> DataFrame:
    """Area under the ROC curve by the trapezoid rule, which counts ties as one half."""
    steps = score_steps(df, y, s)
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    return steps.agg((area / (F.sum("pos") * F.sum("neg"))).alias("roc_auc"))


def precision_recall_curve(df: DataFrame, y: str, s: str) -> DataFrame:
    steps = score_steps(df, y, s)
    return steps.select("threshold", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), (F.col("tp") / F.col("tp_all")).alias("recall"))


def average_precision(df: DataFrame, y: str, s: str) -> DataFrame:
    """Sum of precision times the gain in recall."""
    steps = score_steps(df, y, s)
    return steps.agg((F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.sum("pos")).alias("average_precision"))


def calibration_curve(df: DataFrame, y: str, p: str, n_bins: int = 5) -> DataFrame:
    """bin, share of positives and mean probability in uniform bins."""
    b = F.least(F.floor(F.col(p) * n_bins), F.lit(n_bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.avg(y).alias("prob_true"), F.avg(p).alias("prob_pred"))


def expected_calibration_error(df: DataFrame, y: str, p: str, n_bins: int = 10) -> DataFrame:
    """Gap between confidence and accuracy over bins closed on the right, weighted by their share."""
    conf = F.greatest(F.col(p), 1 - F.col(p))
    hit = (F.col(y) == (F.col(p) >= 0.5).cast("int")).cast("double")
    b = F.greatest(F.ceil(conf * n_bins) - 1, F.lit(0))
    g = df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(conf).alias("c"), F.avg(hit).alias("a"))
    return g.agg((F.sum(F.col("n") * F.abs(F.col("c") - F.col("a"))) / F.sum("n")).alias("ece"))


def regression(df: DataFrame, y: str, p: str, alpha: float = 0.5) -> DataFrame:
    """All regression errors in two aggregates: one for the mean of y, one for the rest; the median by range parts."""
    e = F.col(y) - F.col(p)
    median = percentiles(df, {"e": F.abs(e)}, [0.5], nans=True)["e"][0]
    m = df.agg(F.avg(y).alias("_m"))
    return df.crossJoin(F.broadcast(m)).agg(
        F.avg(e * e).alias("mse"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.lit(median).cast("double").alias("median_ae"),
        F.max(F.abs(e)).alias("max_error"),
        F.avg(F.abs(e) / F.greatest(F.abs(F.col(y)), F.lit(2.220446049250313e-16))).alias("mape"),
        F.avg(F.greatest(alpha * e, (alpha - 1) * e)).alias("pinball"),
        F.when(F.sum((F.col(y) - F.col("_m")) ** 2) == 0, F.when(F.sum(e * e) == 0, 1.0).otherwise(0.0))
        .otherwise(1 - F.sum(e * e) / F.sum((F.col(y) - F.col("_m")) ** 2)).alias("r2"),
        (1 - F.var_pop(e) / F.var_pop(y)).alias("explained_variance"),
    )


def deviances(df: DataFrame, y: str, p: str) -> DataFrame:
    """Mean Poisson and gamma deviances of positive values."""
    a, b = F.col(y), F.col(p)
    poisson = 2 * (F.when(a > 0, a * F.ln(a / b)).otherwise(0.0) - a + b)
    gamma = 2 * (F.ln(b / a) + a / b - 1)
    return df.agg(F.avg(poisson).alias("poisson"), F.avg(gamma).alias("gamma"))


def _pairs(n: Column) -> Column:
    return n * (n - 1) / 2


def clustering_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rand index (adjusted), Fowlkes-Mallows, mutual information and its normalised kin, from one contingency table."""
    c = df.groupBy(F.col(a).alias("y"), F.col(b).alias("p")).agg(F.count("*").alias("n"))
    rows = c.groupBy("y").agg(F.sum("n").alias("a"))
    cols = c.groupBy("p").agg(F.sum("n").alias("b"))
    n = F.col("n_all").cast("double")
    cells = c.join(rows, "y").join(cols, "p").crossJoin(F.broadcast(c.agg(F.sum("n").alias("n_all"))))
    joint = cells.agg(
        F.sum(_pairs(F.col("n"))).alias("cell_pairs"),
        F.sum(F.col("n") / n * F.ln(F.col("n") * n / (F.col("a").cast("double") * F.col("b")))).alias("mi"),
        F.max("n_all").cast("double").alias("n_all"),
    )
    margin = lambda t, x: t.crossJoin(F.broadcast(c.agg(F.sum("n").alias("n_all")))).agg(
        F.sum(_pairs(F.col(x))).alias(f"pairs_{x}"), (-F.sum(F.col(x) / n * F.ln(F.col(x) / n))).alias(f"h_{x}")
    )
    m = joint.crossJoin(margin(rows, "a")).crossJoin(margin(cols, "b"))
    expected = F.col("pairs_a") * F.col("pairs_b") / _pairs(F.col("n_all"))
    top = (F.col("pairs_a") + F.col("pairs_b")) / 2
    hom = F.when(F.col("h_a") == 0, 1.0).otherwise(F.col("mi") / F.col("h_a"))
    com = F.when(F.col("h_b") == 0, 1.0).otherwise(F.col("mi") / F.col("h_b"))
    mean_h = (F.col("h_a") + F.col("h_b")) / 2
    return m.select(
        F.when(top == expected, 1.0).otherwise((F.col("cell_pairs") - expected) / (top - expected)).alias("adjusted_rand"),
        F.when(F.col("pairs_a") * F.col("pairs_b") == 0, 0.0).otherwise(F.col("cell_pairs") / F.sqrt(F.col("pairs_a") * F.col("pairs_b"))).alias("fowlkes_mallows"),
        F.col("mi").alias("mutual_info"),
        F.when(mean_h == 0, 1.0).otherwise(F.col("mi") / mean_h).alias("normalized_mutual_info"),
        hom.alias("homogeneity"),
        com.alias("completeness"),
        F.when(hom + com == 0, 0.0).otherwise(2 * hom * com / (hom + com)).alias("v_measure"),
    )


def dispersion(df: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """Calinski-Harabasz and Davies-Bouldin scores. The pairs compared are pairs of clusters."""
    k = df.groupBy(F.col(label).alias("k")).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"c_{c}") for c in columns])
    mean = df.agg(F.count("*").alias("n_all"), *[F.avg(c).alias(f"m_{c}") for c in columns])
    square = lambda a, b: sum(((F.col(f"{a}{c}") - F.col(f"{b}{c}")) ** 2 for c in columns), F.lit(0.0))
    near = df.select(F.col(label).alias("k"), *[F.col(c).cast("double").alias(f"x_{c}") for c in columns]).join(F.broadcast(k), "k")
    within = near.groupBy("k").agg(F.sum(square("x_", "c_")).alias("w"), F.avg(F.sqrt(square("x_", "c_"))).alias("s"))
    t = k.join(within, "k").crossJoin(mean)
    ch = t.agg(
        ((F.sum(F.col("n") * square("c_", "m_")) / (F.count("*") - 1)) / (F.sum("w") / (F.max("n_all") - F.count("*")))).alias("calinski_harabasz")
    )
    left = t.select("k", "s", *[F.col(f"c_{c}").alias(f"l_{c}") for c in columns])
    right = t.select(F.col("k").alias("k2"), F.col("s").alias("s2"), *[F.col(f"c_{c}").alias(f"r_{c}") for c in columns])
    ratio = (F.col("s") + F.col("s2")) / F.sqrt(square("l_", "r_"))
    db = left.join(F.broadcast(right), F.col("k") != F.col("k2")).groupBy("k").agg(F.max(ratio).alias("r")).agg(F.avg("r").alias("davies_bouldin"))
    return ch.crossJoin(db)


def top_k_accuracy(df: DataFrame, y: Column, probabilities: Column, k: int = 2) -> DataFrame:
    """Share of rows whose class number is among the k largest of an array of probabilities (ties to the lower number)."""
    ranked = F.array_sort(F.transform(probabilities, lambda p, i: F.struct((-p).alias("p"), i.alias("i"))))
    hit = F.exists(F.slice(ranked, 1, k), lambda s: s["i"] == y)
    return df.agg(F.avg(hit.cast("double")).alias("top_k_accuracy"))


# Ranking: rows are (query, item, relevance, score).


def ranking(df: DataFrame, query: str, relevance: str, score: str, tie: str, k: int = 10) -> DataFrame:
    """Per query: DCG and NDCG at k, average precision, reciprocal rank, hit at k. Ties in score are ordered by `tie`."""
    w = Window.partitionBy(query)
    r = df.withColumns({
        "_rank": F.row_number().over(w.orderBy(F.desc(score), tie)),
        "_ideal": F.row_number().over(w.orderBy(F.desc(relevance), tie)),
    }).withColumn("_hits", F.sum((F.col(relevance) > 0).cast("int")).over(w.orderBy("_rank").rowsBetween(Window.unboundedPreceding, 0)))
    gain = lambda at: F.sum(F.when(F.col(at) <= k, F.col(relevance) / F.log2(F.col(at) + 1.0)).otherwise(0.0))
    hit = F.col(relevance) > 0
    g = r.groupBy(query).agg(
        gain("_rank").alias("dcg"), gain("_ideal").alias("ideal"),
        F.sum(F.when(hit, F.col("_hits") / F.col("_rank")).otherwise(0.0)).alias("_p"), F.sum(hit.cast("int")).alias("_n"),
        F.coalesce(1 / F.min(F.when(hit, F.col("_rank"))), F.lit(0.0)).alias("reciprocal_rank"),
        F.max((hit & (F.col("_rank") <= k)).cast("int")).alias("hit"),
    )
    return g.select(
        query, "dcg", F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0).alias("ndcg"),
        F.when(F.col("_n") > 0, F.col("_p") / F.col("_n")).otherwise(0.0).alias("average_precision"), "reciprocal_rank", "hit",
    )


def ranking_means(per_query: DataFrame) -> DataFrame:
    return per_query.agg(
        F.avg("ndcg").alias("ndcg"), F.avg("average_precision").alias("map"), F.avg("reciprocal_rank").alias("mrr"), F.avg("hit").alias("hit_rate")
    )


# Fairness: rows are (truth, prediction, group), both 0/1.


def group_rates(df: DataFrame, y: str, p: str, group: str) -> DataFrame:
    """Per group: selection rate, true and false positive rates, precision."""
    Y, P = F.col(y), F.col(p)
    return df.groupBy(group).agg(
        F.avg(P).alias("selection_rate"), F.avg(F.when(Y == 1, P)).alias("tpr"), F.avg(F.when(Y == 0, P)).alias("fpr"), F.avg(F.when(P == 1, Y)).alias("ppv")
    )


def fairness(df: DataFrame, y: str, p: str, group: str) -> DataFrame:
    """The gaps between groups: parity difference and ratio, opportunity, odds and predictive parity."""
    r = group_rates(df, y, p, group)
    gap = lambda c: F.max(c) - F.min(c)
    return r.agg(
        gap("selection_rate").alias("demographic_parity_difference"),
        F.when(F.max("selection_rate") == 0, 1.0).otherwise(F.min("selection_rate") / F.max("selection_rate")).alias("disparate_impact_ratio"),
        gap("tpr").alias("equal_opportunity_difference"),
        F.greatest(gap("tpr"), gap("fpr")).alias("equalized_odds_difference"),
        gap("ppv").alias("predictive_parity_difference"),
    )


def reweighing(df: DataFrame, y: str, group: str, out: str = "weight") -> DataFrame:
    """Row weights P(group) P(label) / P(group, label) that make group and label independent."""
    c = df.groupBy(F.col(group).alias("_g"), F.col(y).alias("_y")).agg(F.count("*").alias("n"))
    w = c.withColumn(
        "w",
        F.sum("n").over(Window.partitionBy("_g")) * F.sum("n").over(Window.partitionBy("_y")) / (F.col("n") * F.sum("n").over(everything())).cast("double"),
    ).select("_g", "_y", F.col("w").alias(out))
    return df.join(F.broadcast(w), (F.col(group) == F.col("_g")) & (F.col(y) == F.col("_y")), "left").drop("_g", "_y")
