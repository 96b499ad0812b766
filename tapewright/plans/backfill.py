"""Session back-fill: bars and features from the open of each day, put into the history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..operators.align import complete_on_time
from ..operators.bars import with_prefix
from ..operators.history import upsert
from ..operators.xsection import cross_section, symbol_columns
from ..schemas import XSECTION_COLUMNS, SessionSpec
from ..sources.tables import since_open


def session_rows(
    index_bars: DataFrame,
    equity_bars: DataFrame,
    spec: SessionSpec,
    *,
    universe: Sequence[str],
    loadings: DataFrame | None = None,
    prefix: str = "index_",
) -> DataFrame:
    """Index bars since the open, joined with complete cross-section rows of the same time.

    Equities are read from ``lookback_minutes`` before the open, so that their windows are
    filled at the open; features before the open are dropped by the join.
    """
    symbols = symbol_columns(since_open(equity_bars, spec, spec.lookback_minutes))
    features = cross_section(symbols, universe=universe, loadings=loadings)
    columns = [c for c in XSECTION_COLUMNS if c in features.columns]
    return complete_on_time(
        with_prefix(since_open(index_bars, spec), prefix), features, columns
    )


def backfill(history: DataFrame, session: DataFrame, **upsert_options) -> DataFrame:
    """History with the session's rows upserted; repeating it changes nothing."""
    return upsert(history, session, **upsert_options)
