"""The whole way from bars of many symbols to signals, for batch and for one micro-batch."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..operators.align import asof_backward
from ..operators.bars import merge_series, with_prefix
from ..operators.blocks import Ordered
from ..operators.xsection import cross_section, symbol_columns
from ..schemas import XSECTION_COLUMNS
from ..session import materialize
from .features import FeatureSpec, complete_rows, feature_frame, order_history
from .scoring import ModelChain, score
from .signals import signals, with_reference_levels

SPAN_BARS = 4096  # bar times per span of the as-of join


@dataclass(frozen=True)
class SignalPlan:
    """What the steps from bars to signals need.

    ``universe`` may be None if the number of symbols has no known bound. ``index_bars`` in
    the methods are the bars the features are built on; without them the index is all symbols
    taken together.
    """

    universe: Sequence[str] | None
    loadings: DataFrame
    chain: ModelChain
    spec: FeatureSpec = field(default_factory=FeatureSpec)
    index_name: str = "INDEX"

    def history(self, bars: DataFrame, index_bars: DataFrame | None = None) -> DataFrame:
        """Index bars with the newest complete cross-section row at or before each.

        ``bars`` (unique per series and bar time) should be a stored table. The result is one.
        """
        rows = cross_section(
            symbol_columns(bars), universe=self.universe, loadings=self.loadings
        ).na.drop("any", subset=XSECTION_COLUMNS)
        index = merge_series(bars, self.index_name) if index_bars is None else index_bars
        # Both sides of the as-of join are read twice, and both are small next to ``bars``.
        matched = asof_backward(
            materialize(with_prefix(index, self.spec.prefix), "index"),
            materialize(rows, "xsection"),
            columns=XSECTION_COLUMNS,
            span_seconds=self.spec.session.bar_seconds * SPAN_BARS,
        )
        return materialize(matched, "history")

    def features(self, history: DataFrame, **layout) -> Ordered:
        return feature_frame(order_history(history, self.spec, **layout), self.spec)

    def scored(self, frame: Ordered, times: DataFrame | None = None) -> DataFrame:
        """Complete rows of the stored feature frame with scores and reference levels.

        The models and the row filter read a table, so the filter reaches the scan and the
        window plan is not optimized again together with the models. ``times`` restricts the
        rows that are scored.
        """
        levelled = with_reference_levels(frame, self.spec.prefix)
        stored = materialize(levelled.df, "features")
        if times is not None:
            stored = stored.join(times, "bar_ts", "left_semi")
        return score(complete_rows(stored, self.spec), self.chain)

    def __call__(self, bars: DataFrame, times: DataFrame | None = None) -> DataFrame:
        """Signals of all bars, or of the bars at ``times``."""
        scored = self.scored(self.features(self.history(bars)), times)
        return signals(scored, keep=("is_final",) if "is_final" in scored.columns else ())
