"""One run from features to comparison: fits on all folds, stored test scores, and the result tables from these.

Every learner scores every fold's test rows once; the scores are stored by model and fold, and evaluation, curves,
selection, missed fraud and staffing read that table. The selected model is explained and profiled on the last fold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskmill.functions.features import FEATURES
from riskmill.lineage import cut_lineage, ensure_checkpoint_dir, side_by_side
from riskmill.operators import attribution, compare, economics, errors, metrics, models, ranking, tree_attribution
from riskmill.operators.models import Logistic, PreparedFold, fit_trees

Learner = Callable[[PreparedFold], object]
TREES = "boosted_trees"
LEARNERS: Mapping[str, Learner] = {
    "logistic": Logistic(), "ridge": Logistic(strength=0.1), "lasso": Logistic(strength=0.1, l1=True), TREES: fit_trees,
}
KEYS = ("model", "fold")
SCORES_DDL = "row_id long, step long, is_fraud int, score double, model string, fold int"


@dataclass(frozen=True)
class LastFold:
    """The last fold with its models, for what needs a model beside its scores."""

    number: int
    rows: PreparedFold
    models: Mapping[str, object]


def store_scores(folded: DataFrame, folds: Iterable[int], path: str, learners: Mapping[str, Learner] = LEARNERS) -> LastFold:
    """Fits every learner on every fold and stores its test scores under ``path``; an interrupted run starts over.

    Folds are fitted at the same time.
    """
    numbers = list(folds)
    if not numbers:
        raise ValueError("no folds to fit")
    ensure_checkpoint_dir(folded.sparkSession)

    def fit_and_store(number: int) -> LastFold:
        rows = models.prepare_fold(folded, number)
        with models.for_logistic(rows) as ready:
            fitted = fit_learners(ready, learners)
        scores = [models.score_with(model, rows.test).withColumn("model", F.lit(name)) for name, model in fitted.items()]
        reduce(DataFrame.unionByName, scores).write.mode("overwrite").partitionBy("model").parquet(f"{path}/fold={number}")
        return LastFold(number, rows, fitted)
    return side_by_side(fit_and_store, numbers)[-1]


def fit_learners(fold: PreparedFold, learners: Mapping[str, Learner]) -> dict[str, object]:
    """The learners' models by name; logistic regressions are fitted together and share their passes over the rows.

    Beside them trees only queued for the same cores, so the others follow.
    """
    linear = [name for name, learn in learners.items() if isinstance(learn, Logistic)]
    made = dict(zip(linear, models.fit_logistics(fold, [learners[name] for name in linear]))) if linear else {}
    return {name: made[name] if name in made else learn(fold) for name, learn in learners.items()}


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    stored = spark.read.schema(SCORES_DDL).option("basePath", path).parquet(f"{path}/fold=*")
    return stored.select("row_id", "step", "is_fraud", "score", *KEYS)


def explained_rows(last: LastFold, name: str, path: str, names: Sequence[str] = FEATURES) -> DataFrame:
    """The last fold's test rows with the model's contributions and score: Shapley values of the trees, or coefficient
    times scaled value of a linear model."""
    model, rows = last.models[name], last.rows.test
    if name == TREES:
        ensemble = tree_attribution.fitted_ensemble(model, rows.sparkSession, path)
        made = tree_attribution.tree_contributions(rows, ensemble, names)
    else:
        coefficients = dict(zip(names, map(float, model.coefficients)))
        plain = {n: {"mean": 0.0, "scale": 1.0} for n in names}  # the rows are scaled already
        made = attribution.linear_contributions(rows, coefficients, plain, names) \
            .withColumn("margin", attribution.margin(float(model.intercept), names))
    return made.withColumn("score", attribution.probability(F.col("margin")))


def evaluated(ranked: DataFrame, reviews_per_day: float) -> tuple[DataFrame, DataFrame]:
    """Evaluation and curves of every model and fold from stored ``ranked_scores``, both stored."""
    results, curves = side_by_side(cut_lineage, [
        metrics.evaluate(ranked, reviews_per_day, KEYS, ranked), metrics.k_curve(ranked, KEYS, ranked=ranked)])
    return results, curves


def result_tables(scores: DataFrame, last: LastFold, ledger: DataFrame, path: str, reviews_per_day: float,
                  grid: Sequence[float], cost: float, ablation_rounds: int = models.TREE_ROUNDS) -> dict[str, DataFrame]:
    """The eleven tables of a run by name. All that ranks scores reads one stored order of them, while the ablation is fitted."""
    def judged() -> tuple[DataFrame, DataFrame, DataFrame]:
        ranked = cut_lineage(ranking.ranked_scores(scores, KEYS))
        results, curves = evaluated(ranked, reviews_per_day)
        return ranked, results, curves

    def ablation() -> DataFrame:
        return models.ablate(last.rows, last.number, reviews_per_day, ablation_rounds)
    (ranked, results, curves), ablated = side_by_side(lambda work: work(), [judged, ablation])
    best = compare.select_model(results, curves).first().best_model
    final = ranked.where((F.col("model") == best) & (F.col("fold") == last.number)).drop(*KEYS)
    histogram = cut_lineage(ranking.histogram_of_ranks(final))
    sweep = cut_lineage(metrics.histogram_sweep(histogram, grid))
    point = metrics.histogram_sweep(histogram, (reviews_per_day,)).first()
    amount = compare.mean_fraud_amount(ledger.withColumn("is_fraud", F.col("isFraud")).join(final.select("row_id"), "row_id"))
    explained = cut_lineage(explained_rows(last, best, path))
    flagged = F.col("score") >= F.lit(point.threshold)
    return {
        "model_comparison_by_fold": results,
        "model_comparison": compare.compare_models(results),
        "precision_recall_at_k_by_fold": curves,
        "precision_recall_at_k": compare.summarize_curves(curves),
        "global_importance": attribution.global_importance(explained),
        "alert_reasons": attribution.explain_alerts(attribution.alert_queue(explained, flagged)),
        "error_analysis_profile": errors.by_gap(errors.segment_profile(explained, flagged)),
        "missed_fraud_summary": errors.missed_fraud_ranking(final, F.lit(point.n_flagged), ranked=final),
        "capacity_sweep": sweep,
        "feature_ablation": ablated,
        "capacity_economics": economics.net_value_curve(sweep, F.lit(amount.first().avg_fraud_amount), cost=cost),
    }
