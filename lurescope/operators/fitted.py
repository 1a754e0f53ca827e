"""U2 with a fitted model: a saved Spark ML pipeline as scorer, with exact contributions.

``fit`` trains a logistic regression over the numeric features (missing ones count as 0, then each is
centred and scaled) and returns a ``PipelineModel`` to save.  ``LinearScorer`` reads mean, scale and
weight of each feature out of such a pipeline and scores with column expressions: feature ``j`` contributes
``weight_j * (x_j - mean_j) / scale_j`` to the log-odds (for a linear model these are its Shapley values),
and they and the base add up to the log-odds.  So a stream or a batch scores without a model join,
a UDF or a vector column.

Defined results: a missing feature counts as 0; a feature that never varied in training contributes
0; training rows with a null label are left out; a table with a single label gives a constant score.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import SQLTransformer, StandardScaler, StandardScalerModel, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import fixed_values as FV
from . import features as feat
from .scoring import verdict

#: The features with a number in them; the visual and form columns are empty until a collector fills them.
NUMERIC_FEATURES = [c for c in feat.FEATURE_COLUMNS if c not in ("tld", "visual_similarity_score", "dom_credential_form_detected")]
#: Name of the entry of ``shap`` that holds the model's base value.
BASE = "base"


def _number(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def fit(features: DataFrame, label_col: str, columns: list[str] | None = None, reg: float = 0.01, max_iter: int = 50) -> PipelineModel:
    """A logistic regression of ``label_col`` (0 or 1, or boolean) over ``columns`` (default: all numeric features)."""
    columns = columns or NUMERIC_FEATURES
    numbers = ", ".join(f"coalesce(cast(`{c}` as double), 0.0D) AS `_x_{c}`" for c in columns)
    stages = [SQLTransformer(statement=f"SELECT *, {numbers} FROM __THIS__"),
              VectorAssembler(inputCols=[f"_x_{c}" for c in columns], outputCol="_x"),
              StandardScaler(inputCol="_x", outputCol="_z", withMean=True, withStd=True),
              LogisticRegression(featuresCol="_z", labelCol="_label", regParam=reg, maxIter=max_iter, standardization=False,
                                 probabilityCol="_probability", rawPredictionCol="_margin", predictionCol="_predicted")]
    rows = features.withColumn("_label", F.col(label_col).cast("double")).filter("_label is not null").select("_label", *columns)
    return Pipeline(stages=stages).fit(rows)


def _stage(model: PipelineModel, kind: type):
    found = [s for s in model.stages if isinstance(s, kind)]
    if len(found) != 1:
        raise ValueError(f"the pipeline must have one {kind.__name__}, this one has {len(found)}")
    return found[0]


@dataclass(frozen=True)
class LinearScorer:
    """A scorer (U2): adds ``score`` (0 to 100), ``verdict``, ``confidence`` (the probability) and ``shap``."""
    columns: list[str]
    weights: list[float]
    means: list[float]
    scales: list[float]
    base: float
    high: int = FV.HIGH_RISK_THRESHOLD
    medium: int = FV.MEDIUM_RISK_THRESHOLD
    labels: dict[str, str] = field(default_factory=dict)

    @classmethod
    def of(cls, model: PipelineModel, **options) -> LinearScorer:
        linear, scaler = _stage(model, LogisticRegressionModel), _stage(model, StandardScalerModel)
        columns = [c.removeprefix("_x_") for c in _stage(model, VectorAssembler).getInputCols()]
        return cls(columns, [float(w) for w in linear.coefficients.toArray()], [float(m) for m in scaler.mean.toArray()],
                   [float(s) for s in scaler.std.toArray()], float(linear.intercept), **options)

    @classmethod
    def load(cls, path: str, **options) -> LinearScorer:
        return cls.of(PipelineModel.load(path), **options)

    def _contribution(self, j: int) -> Column:
        if self.scales[j] == 0.0:
            return F.lit(0.0)
        return F.lit(self.weights[j]) * (_number(self.columns[j]) - F.lit(self.means[j])) / F.lit(self.scales[j])

    def __call__(self, df: DataFrame) -> DataFrame:
        each = [(c, self.labels.get(c, c.replace("_", " ")), _number(c), self._contribution(j)) for j, c in enumerate(self.columns)]
        each.append((BASE, "base value", F.lit(1.0), F.lit(self.base)))
        entries = F.array(*[F.struct(F.lit(name).alias("feature"), F.lit(label).alias("label"), value.alias("value"),
                                     part.alias("shap_value"), F.when(part > 0, F.lit("up")).when(part < 0, F.lit("down"))
                                     .otherwise(F.lit("none")).alias("direction")) for name, label, value, part in each])
        odds = F.aggregate("shap", F.lit(0.0), lambda acc, e: acc + e["shap_value"])
        return (df.withColumn("shap", entries)
                  .withColumn("confidence", F.lit(1.0) / (F.lit(1.0) + F.exp(-odds)))
                  .withColumn("score", F.round(F.col("confidence") * 100).cast("int"))
                  .withColumn("verdict", verdict(F.col("score"), self.high, self.medium)))
