"""Evaluation and report tables as DataFrame plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.core import size_bucket

from .storage import saved


def accuracy(predicted: str, actual: str, where: Column | None = None) -> Column:
    """Share of equal pairs among rows where `where` holds; 0 if there are none."""
    hit = (F.col(predicted) == F.col(actual)).cast("double")
    return F.coalesce(F.avg(F.when(where, hit) if where is not None else hit), F.lit(0.0))


def auc(scores: DataFrame, score: str = "score", positive: str = "positive", missing: float = 0.5) -> DataFrame:
    """One row: ROC-AUC, ties counting half; `missing` if a class is empty. Rows are counted by score first; scores are ranked
    in sorted ranges, whose counts are added up, so that no task holds them all."""
    per = scores.groupBy(score).agg(F.sum(F.col(positive).cast("long")).alias("p"), F.sum((~F.col(positive)).cast("long")).alias("n"))
    per = saved(per.repartitionByRange(score).withColumn("_range", F.spark_partition_id()), "scores")
    ranges = per.groupBy("_range").agg(F.sum("n").alias("_n")).withColumn("_under", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    below = Window.partitionBy("_range").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("under", F.coalesce(F.sum("n").over(below), F.lit(0))).join(F.broadcast(ranges.select("_range", "_under")), "_range")
    out = per.agg(F.sum(F.col("p") * (F.col("under") + F.col("_under") + F.col("n") / 2)).alias("u"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return out.select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.round(F.col("u") / F.col("p") / F.col("n"), 6)).otherwise(F.lit(missing)).alias("auc"))


def weighted(value: str, weight: str, missing: float = 0.0) -> Column:
    return F.coalesce(F.sum(F.col(value) * F.col(weight)) / F.nullif(F.sum(weight), F.lit(0)), F.lit(missing))


def by_bucket(results: DataFrame) -> DataFrame:
    """(size_bucket, n_communities, n_test, accuracy): community results weighted by their test nodes."""
    out = results.withColumn("size_bucket", size_bucket(F.col("n_nodes"))).groupBy("size_bucket")
    return out.agg(F.count("*").alias("n_communities"), F.sum("n_test").alias("n_test"), F.round(weighted("accuracy", "n_test"), 6).alias("accuracy"))


def histogram(values: DataFrame, column: str, n: int = 40, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(bin from 0, low, n) of the bins that hold values; the last bin holds its upper bound."""
    b = F.least(F.floor((F.col(column) - low) / (high - low) * n), F.lit(n - 1)).cast("int")
    return values.where(F.col(column).between(low, high)).groupBy(b.alias("bin")).agg(F.count("*").alias("n")).withColumn("low", F.round(low + F.col("bin") * (high - low) / n, 6))


def timing_table(timings: DataFrame, phases: Sequence[str]) -> DataFrame:
    """(dataset, variant, one column per phase, total); a phase without a time counts 0."""
    out = timings.groupBy("dataset", "variant").pivot("phase", list(phases)).agg(F.sum("seconds")).na.fill(0.0)
    return out.withColumn("total", F.round(sum((F.col(p) for p in phases), F.lit(0.0)), 6))


def gaps(results: DataFrame, baselines: DataFrame) -> DataFrame:
    """Results by (dataset, model) with acc_gap and auc_gap, baseline less engine; null only where one is missing."""
    b = baselines.select("dataset", "model", F.col("accuracy").alias("b_acc"), F.col("auc").alias("b_auc"))
    return results.join(b, ["dataset", "model"], "left").withColumns({"acc_gap": F.col("b_acc") - F.col("accuracy"), "auc_gap": F.col("b_auc") - F.col("auc")}).drop("b_acc", "b_auc")


def latex(rows: Sequence[Sequence], header: Sequence[str]) -> str:
    """A report table, small by nature, as a LaTeX tabular."""
    lines = [" & ".join(map(str, r)) + r" \\" for r in (header, *rows)]
    return "\n".join([rf"\begin{{tabular}}{{{'l' * len(header)}}}", lines[0], r"\hline", *lines[1:], r"\end{tabular}"])


def accuracy_table(results: DataFrame, by: Sequence[str] = ("dataset", "algorithm", "model_type")) -> DataFrame:
    """A row per dataset, algorithm and model of community results: communities, accuracy weighted by test nodes, means over communities, those at the
    boundary and inside over the communities that have such nodes (0 without any), and the link AUC, mean and weighted by edges."""
    out = results.groupBy(*by).agg(
        F.count("*").alias("n_communities"),
        weighted("comm_test_acc", "n_test").alias("weighted_comm_acc"),
        F.avg("comm_test_acc").alias("mean_comm_acc"),
        F.coalesce(F.avg(F.when(F.col("n_boundary") > 0, F.col("boundary_acc"))), F.lit(0.0)).alias("mean_boundary_acc"),
        F.coalesce(F.avg(F.when(F.col("n_internal") > 0, F.col("internal_acc"))), F.lit(0.0)).alias("mean_internal_acc"),
        F.avg("comm_link_auc").alias("mean_comm_link_acc"),
        weighted("comm_link_auc", "n_edges").alias("weighted_comm_link_auc"),
    )
    return out.select(*by, *[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes if c not in by])


#: Columns of the summary, in order: fixed names of the report.
SUMMARY = (
    "experiment dataset algorithm model_type n_communities global_test_acc mean_comm_acc mean_boundary_acc mean_internal_acc weighted_comm_acc baseline_acc acc_gap "
    "mean_comm_link_acc weighted_comm_link_auc baseline_link_auc auc_gap phase1_s phase2_s phase3_s total_123_s baseline_s"
).split()


def summary_table(experiment: str, results: DataFrame, baselines: DataFrame, timings: DataFrame) -> DataFrame:
    """SUMMARY's 21 columns for each dataset, algorithm and model. baselines: (dataset, model_type, test_acc, link_auc, seconds);
    timings: (dataset, algorithm, model_type, phase, seconds), with a null model_type for the phases before training. A
    missing baseline or time is null, in the total 0; gaps are baseline less engine, null where one is missing, also at 0 for accuracy."""
    table = accuracy_table(results)
    phase = lambda p: F.sum(F.when(F.col("phase") == p, F.col("seconds")))
    early = timings.where("model_type is null").groupBy("dataset", "algorithm").agg(phase("phase1").alias("phase1_s"), phase("phase2").alias("phase2_s"))
    late = timings.groupBy("dataset", "algorithm", "model_type").agg(phase("phase3").alias("phase3_s"))
    base = baselines.select("dataset", "model_type", F.col("test_acc").alias("baseline_acc"), F.col("link_auc").alias("baseline_link_auc"), F.col("seconds").alias("baseline_s"))
    out = table.join(early, ["dataset", "algorithm"], "left").join(late, ["dataset", "algorithm", "model_type"], "left").join(base, ["dataset", "model_type"], "left")
    acc, zero = F.col("weighted_comm_acc"), F.lit(0.0)
    out = out.withColumns({
        "experiment": F.lit(experiment),
        "global_test_acc": acc,
        "acc_gap": F.round(F.nullif(F.col("baseline_acc"), zero) - F.nullif(acc, zero), 6),
        "auc_gap": F.round(F.col("baseline_link_auc") - F.col("weighted_comm_link_auc"), 6),
        "total_123_s": sum((F.coalesce(c, zero) for c in ("phase1_s", "phase2_s", "phase3_s")), zero),
    })
    return out.select(*SUMMARY)


def summary_box(experiment: str, rows: Sequence, width: int = 62) -> str:
    """A summary's rows, one per dataset, algorithm and model and small by nature, in a frame of text."""
    line = lambda label, value: f"| {f'{label:<30} {value}':<{width - 2}} |"
    shown = lambda v, unit="": "-" if v is None else f"{v:.4f}" if not unit else f"{v:.1f}{unit}"
    edge, out = "+" + "-" * width + "+", []
    out += [edge, line("experiment", experiment), edge]
    for r in rows:
        name = f"[{r['algorithm']}-{r['model_type']}]"
        out += [line("dataset", r["dataset"]), line(f"{name} communities", r["n_communities"])]
        out += [line(f"{name} {label}", shown(r[c])) for label, c in (("accuracy", "weighted_comm_acc"), ("boundary accuracy", "mean_boundary_acc"), ("internal accuracy", "mean_internal_acc"), ("link AUC", "weighted_comm_link_auc"))]
        out += [line("baseline accuracy", shown(r["baseline_acc"])), line("baseline link AUC", shown(r["baseline_link_auc"])), line("seconds, phases 1 to 3", shown(r["total_123_s"], "s")), edge]
    return "\n".join(out)
