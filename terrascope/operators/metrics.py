"""Classification metrics (M11, M12) from one tiny confusion table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Class names of the segmentation labels.
CLASS_NAMES = {0: "Deforested", 1: "Forest"}


def classification_report(pred: DataFrame, label: str = "label", prediction: str = "prediction",
                          names: dict[int, str] = CLASS_NAMES) -> DataFrame:
    """M11 + M12: per class precision, recall, F1 and support; accuracy;
    macro and weighted averages.  Columns ``class, precision, recall,
    f1_score, support``.

    One aggregation pass over the predictions (conditional counts per class,
    partial aggregation); every report row is then derived from that single
    row in one projection (``inline`` of an array of structs).
    """
    y, p = F.col(label).cast("int"), F.col(prediction).cast("int")
    counts = []
    for c in names:
        counts += [F.count_if((y == c) & (p == c)).alias(f"tp{c}"), F.count_if(p == c).alias(f"pp{c}"),
                   F.count_if(y == c).alias(f"n{c}")]
    one = pred.agg(*counts)

    def ratio(a, b):
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    prec = {c: ratio(F.col(f"tp{c}"), F.col(f"pp{c}")) for c in names}
    rec = {c: ratio(F.col(f"tp{c}"), F.col(f"n{c}")) for c in names}
    f1 = {c: F.when(prec[c] + rec[c] > 0, F.lit(2.0) * prec[c] * rec[c] / (prec[c] + rec[c])).otherwise(F.lit(0.0))
          for c in names}
    total = sum((F.col(f"n{c}") for c in names), F.lit(0))
    k = F.lit(float(len(names)))

    def row(name, pr, re, f, sup):
        return F.struct(F.lit(name).alias("class"), pr.cast("double").alias("precision"),
                        re.cast("double").alias("recall"), f.cast("double").alias("f1_score"),
                        sup.cast("long").alias("support"))

    rows = [row(n, prec[c], rec[c], f1[c], F.col(f"n{c}")) for c, n in names.items()]
    rows.append(row("accuracy", F.lit(None), F.lit(None),
                    ratio(sum((F.col(f"tp{c}") for c in names), F.lit(0)), total), total))
    rows.append(row("macro avg", sum(prec.values(), F.lit(0.0)) / k, sum(rec.values(), F.lit(0.0)) / k,
                    sum(f1.values(), F.lit(0.0)) / k, total))
    rows.append(row("weighted avg",
                    ratio(sum((prec[c] * F.col(f"n{c}") for c in names), F.lit(0.0)), total),
                    ratio(sum((rec[c] * F.col(f"n{c}") for c in names), F.lit(0.0)), total),
                    ratio(sum((f1[c] * F.col(f"n{c}") for c in names), F.lit(0.0)), total), total))
    return one.select(F.inline(F.array(*rows)))
