"""Model fitting and batch scoring with Spark ML."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe import schemas as S
from riskframe.functions.scalar import APPROVAL_THRESHOLD, approved, risk_tier
from riskframe.operators.boosting import HistModel, fit_hist_boost, score_hist_boost
from riskframe.operators.gradient import fit_gradient_trees
from riskframe.operators.metrics import extended_metrics
from riskframe.operators.prep import (
    CategoryCodes, Imputer, fit_codes, fit_imputer, present, temporal_split,
)
from riskframe.session import cut_lineage

# fixed values: default model parameters
GBT_PARAMS = {"maxIter": 100, "maxDepth": 5, "stepSize": 0.05, "seed": 42}
LOGREG_PARAMS = {"maxIter": 1000}
LOGREG_C = 1.0


def fit_gbt(train: DataFrame, features: str = "features", label: str = "label",
            params: dict[str, Any] | None = None) -> Model:
    """Gradient-boosted trees."""
    return fit_gradient_trees(train, GBTClassifier(featuresCol=features, labelCol=label, **{**GBT_PARAMS, **(params or {})}))


def fit_logreg(train: DataFrame, features: str = "features", label: str = "label",
               params: dict[str, Any] | None = None, c: float = LOGREG_C) -> Model:
    """L2 logistic regression with inverse strength ``c`` (Spark divides the loss by the row count)."""
    n = train.count()
    settings = {**LOGREG_PARAMS, "regParam": 1.0 / (c * max(n, 1)), "elasticNetParam": 0.0,
                "standardization": False, **(params or {})}
    return LogisticRegression(featuresCol=features, labelCol=label, **settings).fit(train)


FITTERS = {"gbt": fit_gbt, "logistic_regression": fit_logreg}


def fit_model(train: DataFrame, model_type: str = "gbt", params: dict[str, Any] | None = None,
              features: str = "features", label: str = "label") -> Model:
    if model_type not in FITTERS:
        raise ValueError(f"unsupported model type: {model_type}")
    return FITTERS[model_type](train, features, label, params)


def save_model(model: Any, path: str) -> None:
    """Write a model (or pipeline model) with the Spark ML writer."""
    target = model if isinstance(model, PipelineModel) else PipelineModel(stages=[model])
    target.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    try:
        return PipelineModel.load(path)
    except Exception as exc:  # missing paths surface as different JVM errors
        text = str(exc)
        if isinstance(exc, AnalysisException) or "does not exist" in text or "NotExist" in text or "empty collection" in text:
            raise FileNotFoundError(path) from exc
        raise


def positive_probability(probability: str = "probability") -> Column:
    return vector_to_array(probability)[1]


def score(df: DataFrame, model: Any, out: str = "score", keep: Sequence[str] | None = None) -> DataFrame:
    """Positive-class probability as one more column."""
    if model is None:
        raise ValueError("no model to score with")
    cols = list(keep) if keep is not None else df.columns
    return model.transform(df).withColumn(out, positive_probability()).select(*cols, out)


def decide(scored: DataFrame, score: str = "score", id_col: str | None = None,
           threshold: float = APPROVAL_THRESHOLD) -> DataFrame:
    """Decision table: score id, risk score, tier, approval; an id is made where none is given."""
    made = F.concat(F.lit("score-"), F.substring(F.uuid(), 1, 8))
    given = F.coalesce(F.col(id_col).cast("string"), made) if id_col else made
    return scored.select(given.alias("score_id"), F.col(score).alias("risk_score"),
                         risk_tier(score).alias("risk_tier"), approved(score, threshold).alias("approved"))


@dataclass(frozen=True)
class CreditModel:
    """Everything scoring needs: medians, codes, feature order, fitted model."""

    features: tuple[str, ...]
    imputer: Imputer
    codes: CategoryCodes
    model: Any

    def prepare(self, df: DataFrame) -> DataFrame:
        """Features imputed and coded, as columns."""
        ready = self.codes.apply(self.imputer.apply(df))
        missing = [c for c in self.features if c not in ready.columns]
        if missing:
            raise ValueError(f"missing features: {missing}")
        return ready

    def assemble(self, df: DataFrame) -> DataFrame:
        ready = self.prepare(df)
        # imputing replaces the feature columns, so scored rows keep their raw attributes aside
        return VectorAssembler(inputCols=list(self.features), outputCol="features",
                               handleInvalid="keep").transform(ready)

    def score(self, df: DataFrame, keep: Sequence[str] = (), out: str = "score") -> DataFrame:
        aside = {c: f"__raw_{c}" for c in keep}
        wide = df.withColumns({tmp: F.col(c) for c, tmp in aside.items()}) if aside else df
        if isinstance(self.model, HistModel):
            scored = score_hist_boost(self.prepare(wide), self.model, list(aside.values()), out)
        else:
            scored = self.model.transform(self.assemble(wide)).withColumn(out, positive_probability())
        return scored.select(*[F.col(tmp).alias(c) for c, tmp in aside.items()], out)


def train_credit_model(train: DataFrame, model_type: str = "gbt", params: dict[str, Any] | None = None,
                       numeric: Sequence[str] = tuple(S.NUMERICAL_FEATURES),
                       categorical: Sequence[str] = tuple(S.CATEGORICAL_FEATURES),
                       target: str = S.TARGET, fit_on: DataFrame | None = None) -> CreditModel:
    """Medians and codes from the training rows (or ``fit_on`` for parity), then the classifier.

    ``model_type`` is one of ``FITTERS`` or "hist_gbt", histogram boosting on the feature columns.
    """
    base = train if fit_on is None else fit_on
    imputer, codes = fit_imputer(base, numeric), fit_codes(base, categorical)
    features = tuple(present(train, [*numeric, *categorical]))
    shell = CreditModel(features, imputer, codes, None)
    if model_type == "hist_gbt":
        rows = shell.prepare(train).withColumn("__label", F.col(target).cast("double"))
        return CreditModel(features, imputer, codes, fit_hist_boost(rows, features, "__label", **(params or {})))
    # the fitters cache rows in a form of their own: a written table spares imputing again without a second copy in memory
    ready = cut_lineage(shell.assemble(train).select("features", F.col(target).cast("double").alias("label")))
    return CreditModel(features, imputer, codes, fit_model(ready, model_type, params))


def run_training(df: DataFrame, model_type: str = "gbt", params: dict[str, Any] | None = None,
                 date_col: str = "issue_d", target: str = S.TARGET, cutoff: str = S.SPLIT_DATE,
                 **kwargs: Any) -> tuple[CreditModel, DataFrame]:
    """Split by time, fit on train, evaluate on test: (model, one metric row)."""
    train, test = temporal_split(df, date_col, target, cutoff)
    model = train_credit_model(train, model_type, params, target=target, **kwargs)
    scored = cut_lineage(model.score(test, keep=[target]))  # the metrics read it several times
    return model, extended_metrics(scored, target, "score")
