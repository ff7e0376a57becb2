"""Several operators combined into the questions a user asks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core.sizing import join_stats
from ..operators import attribution as AT
from ..operators import clusters as CL
from ..operators import drilldown as D
from ..operators import joint as JT
from ..operators import scenario as SC
from ..operators import tags as A
from ..operators.linear import Predict
from ..operators.periods import BASELINE, TARGET, label_periods


def feature_table(long: DataFrame, dictionary: DataFrame, tags: Sequence[str], glossary: DataFrame, drop: Sequence[str], derive, order: str | None = None) -> DataFrame:
    """Tag series to a clean wide table: pivot, rename, derive, keep glossary columns, clean names."""
    named = A.rename_tags(A.series_to_wide(long, tags, order=order), dictionary, "ts")
    return A.clean_column_names(A.align_columns(derive(named), glossary, drop))


def diagnosis(
    df: DataFrame, target: tuple[str, str], baseline: tuple[str, str], components: Sequence[str], total: str,
    grades: Sequence[str] | None = None, ts: str = "ts", grade: str = "grade",
) -> dict[str, DataFrame]:
    """All drill-down levels, mix and cost effect, and sentences. One grade alone needs no total level."""
    rows = label_periods(df, ts, target, baseline)
    if grades is not None:
        rows = rows.filter(F.col(grade).isin(list(grades)))
    levels = D.drilldown_levels(rows, components, total, grade)
    if grades is not None and len(grades) == 1:
        levels = levels.filter(F.col("level") != 1)
    return {
        "levels": levels,
        "effects": D.mix_effect(rows, total, grade=grade),
        "sentences": levels.select("level", grade, "cost", D.drilldown_sentence(grade).alias("sentence")),
    }


@dataclass
class CostDrivers:
    """Result tables of a cost driver analysis."""

    clustered: DataFrame
    extremes: DataFrame
    diagnostics: DataFrame
    contributions: DataFrame
    differences: DataFrame


def cost_drivers(
    df: DataFrame, target: tuple[str, str], baseline: tuple[str, str], grades: Sequence[str], component: str, features: Sequence[str],
    predict: Predict, top_n: int = 7, permutations: int = 500, ts: str = "ts", grade: str = "grade", **cluster_options,
) -> CostDrivers:
    """Cluster both periods, compare the extreme clusters, attribute the change and rank the drivers."""
    rows = label_periods(df, ts, target, baseline).filter(F.col(grade).isin(list(grades)))
    clustered = CL.cluster_by_period(rows, features, component, grade, **cluster_options)
    extremes = CL.extreme_clusters(clustered, component, grade)
    pairs = AT.mean_pairs(extremes, features, [grade])
    shares = AT.shapley_sampled(pairs, [grade], features, predict, permutations)
    diag = AT.relevance(pairs, shares, AT.feature_spread(rows, features), [grade], features)
    diag = AT.priority_score(AT.keep_relevant(diag, [grade]))
    top = AT.top_driver_variables(diag, top_n)
    diff = D.mean_differences(extremes, features, F.col("period") == BASELINE, F.col("period") == TARGET)
    return CostDrivers(clustered, extremes, diag, AT.relative_contributions(shares, pairs, [grade], features), join_stats(diff, top, ["variable"], how="left_semi"))


def what_if(
    history: DataFrame, rows: DataFrame, changes: Sequence[SC.Change], predict: Predict, inputs: Sequence[str], keys: Sequence[str],
    variables: Sequence[str], grade: str = "grade", min_rows: int = 200, **bounds,
) -> DataFrame:
    """Calibrate changes to what history supports, then predict cost before and after for every row."""
    model = JT.fit_joint(history, variables, grade, min_rows)
    fitted = SC.calibrate(rows.withColumn("baseline_prediction", predict(F.col)), model, changes, **bounds)
    after = fitted.withColumn("scenario_prediction", predict(F.col))
    notes = [c for c in after.columns if c.endswith(("_requested", "_low", "_high", "_clipped"))]
    diff = F.col("scenario_prediction") - F.col("baseline_prediction")
    return after.select(*keys, "baseline_prediction", "scenario_prediction", diff.alias("difference"), *notes)
