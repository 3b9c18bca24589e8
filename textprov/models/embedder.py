"""Text vectors of unit length, for nearest-neighbour look-up."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame

from textprov.models.detector import _words_stage

DIMENSIONS = 512


def _counting(dimensions: int) -> list:
    return [
        _words_stage("text", "_words"),
        HashingTF(numFeatures=dimensions, inputCol="_words", outputCol="_tf"),
    ]


def count_words(df: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """``_tf``, the counts of a text's hashed words, in place of ``text``.

    Stored, the counts serve ``fit_embedder`` and ``embed`` alike, so texts are split once.
    """
    return PipelineModel(_counting(dimensions)).transform(df).drop("text", "_words")


def fit_embedder(corpus: DataFrame, dimensions: int = DIMENSIONS) -> PipelineModel:
    """The model is one weight per dimension, whatever the vocabulary.

    ``corpus`` has ``text``, or the ``_tf`` of ``count_words``, which then sets the dimensions.
    """
    counted = corpus if "_tf" in corpus.columns else count_words(corpus.select("text"), dimensions)
    idf = IDF(inputCol="_tf", outputCol="_weighted").fit(counted.select("_tf"))
    unit = Normalizer(p=2.0, inputCol="_weighted", outputCol="_unit")
    return PipelineModel([*_counting(len(idf.idf)), idf, unit])


def embed(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add ``vec``; zeros for a text without words. ``df`` as for ``fit_embedder``."""
    counting, weighing = model.stages[:2], model.stages[2:]
    stages = weighing if "_tf" in df.columns else [*counting, *weighing]
    return PipelineModel(stages).transform(df).select(*df.columns, vector_to_array("_unit").alias("vec"))
