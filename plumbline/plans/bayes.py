"""Gaussian naive Bayes with smoothed variances, a setting that Spark's own form lacks."""

from __future__ import annotations

from pyspark.ml import Estimator
from pyspark.ml import classification as cls
from pyspark.ml.common import _py2java
from pyspark.ml.linalg import DenseMatrix
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame


class SmoothedBayes(Estimator):
    """Spark's Gaussian form; `varSmoothing` times the largest variance is added to every variance."""

    varSmoothing = Param(Params._dummy(), "varSmoothing", "share of the largest variance added to all", TypeConverters.toFloat)

    def __init__(self, varSmoothing: float = 0.0, weightCol: str | None = None):
        super().__init__()
        self.weight = {"weightCol": weightCol} if weightCol else {}
        self._setDefault(varSmoothing=0.0)
        self._set(varSmoothing=varSmoothing)

    def _fit(self, dataset: DataFrame) -> cls.NaiveBayesModel:
        plain = cls.NaiveBayes(modelType="gaussian", **self.weight).fit(dataset)
        share = self.getOrDefault(self.varSmoothing)
        if share == 0:
            return plain
        variances = plain.sigma.toArray()
        wider = DenseMatrix(*variances.shape, (variances + share * variances.max()).flatten("F").tolist())
        context, fitted = dataset.sparkSession.sparkContext, plain._java_obj
        made = context._jvm.org.apache.spark.ml.classification.NaiveBayesModel(
            fitted.uid(), fitted.pi(), fitted.theta(), _py2java(context, wider)
        )
        return plain._copyValues(cls.NaiveBayesModel(made))
