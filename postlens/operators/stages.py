"""Text steps as pipeline stages, so that a saved classifier takes raw text."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Pipeline, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import preprocess_tokens, vector_tokens
from .models import CountedClassifier, vector_stages


class TextTokens(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Raw text → array of tokens, by column functions alone. Null text gives no tokens.

    `rule` is "clean" (the clean-up chain, stop words left out) or "plain" (lower-cased word runs). The rule and the stop words
    are parameters of the stage, saved and loaded with the pipeline.
    """

    rule = Param(Params._dummy(), "rule", "clean or plain", TypeConverters.toString)
    stopWords = Param(Params._dummy(), "stopWords", "words to leave out", TypeConverters.toListString)

    @keyword_only
    def __init__(self, inputCol: str = "text", outputCol: str = "tokens", rule: str = "clean", stopWords: list[str] | None = None):
        super().__init__()
        self._setDefault(inputCol="text", outputCol="tokens", rule="clean", stopWords=[])
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        text = F.coalesce(F.col(self.getInputCol()), F.lit(""))
        rule = self.getOrDefault(self.rule)
        if rule not in ("clean", "plain"):
            raise ValueError(f"unknown rule: {rule}")
        found = vector_tokens(text) if rule == "plain" else preprocess_tokens(text, self.getOrDefault(self.stopWords))
        return dataset.withColumn(self.getOutputCol(), found)


def text_classifier(model: str, params: dict | None = None, stops: list[str] | None = None, feat: str = "count", norm: str | None = None,
                    multiclass: bool = False, max_df: float | None = 0.8, max_iter: int = 100, rule: str = "clean") -> Pipeline:
    """<text, label> → tokens → vectors → classifier, one pipeline; its fitted form, saved and loaded, needs text alone."""
    return Pipeline(stages=[TextTokens(rule=rule, stopWords=stops), *vector_stages(feat, norm, max_df), CountedClassifier(model, params, multiclass, max_iter)])
