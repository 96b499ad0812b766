"""The chain of three classifiers, scored on every row.

A scorer adds columns with class probabilities. Three kinds share that interface: logistic
coefficients, which become plain column expressions, any fitted Spark ML pipeline, and a
foreign model behind a vectorized UDF.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import model_input
from ..schemas import META_FEATURES, require_columns


@dataclass(frozen=True)
class LogisticScorer:
    """Coefficients of one binary model, in feature order."""

    features: tuple[str, ...]
    weights: tuple[float, ...]
    intercept: float

    def __call__(self, rows: DataFrame, down: str | None, up: str) -> DataFrame:
        require_columns(rows.columns, list(self.features))
        terms = [
            model_input(n) * F.lit(w) for n, w in zip(self.features, self.weights, strict=True)
        ]
        margin = reduce(lambda a, b: a + b, terms, F.lit(self.intercept))
        p = 1.0 / (1.0 + F.exp(-margin))
        return rows.withColumns({up: p} | ({down: 1.0 - p} if down else {}))

    @classmethod
    def from_table(cls, table: DataFrame, features: Sequence[str]) -> LogisticScorer:
        """From rows (feature, weight); the row without a feature name is the intercept.

        At most one row per feature of the declared list reaches the driver.
        """
        wanted = table.where(F.col("feature").isNull() | F.col("feature").isin(*features))
        rows = wanted.groupBy("feature").agg(F.sum("weight").alias("weight"))
        found = {r["feature"]: r["weight"] for r in rows.collect()}
        return cls(
            tuple(features), tuple(found.get(n, 0.0) for n in features), found.get(None, 0.0)
        )


@dataclass(frozen=True)
class PipelineScorer:
    """A fitted Spark ML pipeline that assembles ``features`` itself and writes
    ``probability``."""

    model: PipelineModel
    features: tuple[str, ...]

    def __call__(self, rows: DataFrame, down: str | None, up: str) -> DataFrame:
        require_columns(rows.columns, list(self.features))
        scored = self.model.transform(rows.withColumns({n: model_input(n) for n in self.features}))
        both = vector_to_array("probability")
        added = [both[1].alias(up)] + ([both[0].alias(down)] if down else [])
        return scored.select(*rows.columns, *added)

    @classmethod
    def load(cls, path: str, features: Sequence[str]) -> PipelineScorer:
        return cls(PipelineModel.load(path), tuple(features))


@dataclass(frozen=True)
class PandasScorer:
    """A foreign model: ``predict`` maps a frame of the features to class-1 probabilities."""

    features: tuple[str, ...]
    predict: Callable[[pd.DataFrame], pd.Series]

    def __call__(self, rows: DataFrame, down: str | None, up: str) -> DataFrame:
        require_columns(rows.columns, list(self.features))
        predict = self.predict

        @F.pandas_udf("double")
        def probability(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            for frame in batches:
                yield pd.Series(predict(frame))

        inputs = F.struct(*[model_input(n).alias(n) for n in self.features])
        out = rows.withColumn(up, probability(inputs))
        return out.withColumn(down, 1.0 - F.col(up)) if down else out


Scorer = Callable[[DataFrame, str | None, str], DataFrame]


@dataclass(frozen=True)
class ModelChain:
    """Expansion, direction and win model."""

    expansion: Scorer
    direction: Scorer
    win: Scorer


def score(features: DataFrame, chain: ModelChain) -> DataFrame:
    """Add ``exp_p, p_down, p_up, side, p_win``.

    The win model sees the inputs and results of the first two; a tie between up and down
    counts as down. Scorers clean their inputs themselves. Pass stored features: probabilities
    are long expressions, and a filter on one is evaluated wherever it is pushed to.
    """
    rows = chain.expansion(features, None, "exp_p")
    rows = chain.direction(rows, "p_down", "p_up")
    rows = rows.withColumn("side", F.when(F.col("p_up") > F.col("p_down"), 1).otherwise(-1))
    return chain.win(rows, None, "p_win")


def stacked_row(scored: DataFrame, *extra: str) -> DataFrame:
    """The win model's input columns in model order."""
    results = ("exp_p", "p_up", "p_down", "side")
    return scored.select(
        *extra,
        *[F.col(n) if n in results else model_input(n).alias(n) for n in META_FEATURES],
    )
