"""From scored rows to entry, stop and target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.blocks import Ordered
from ..operators.windows import reference_levels
from ..schemas import META_THRESHOLD, REFERENCE_ROWS, STOP_R, TARGET_R


def with_reference_levels(
    bars: Ordered, prefix: str = "index_", rows: int = REFERENCE_ROWS
) -> Ordered:
    """Add ``hi_ref`` and ``lo_ref``; needs ``is_final`` only if bars may be provisional."""
    final = F.col("is_final") if "is_final" in bars.df.columns else None

    def levels(w) -> dict[str, Column]:
        high, low = reference_levels(prefix + "high", prefix + "low", w, rows, final)
        return {"hi_ref": high, "lo_ref": low}

    return bars.derive(rows + 1, levels)


def signals(
    scored: DataFrame, threshold: float = META_THRESHOLD, *, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Rows that pass the probability gate, with their price levels.

    ``feature_ts`` is the time the features belong to, ``bar_ts`` the bar they are used on.
    """
    feature_ts = F.col("feature_ts") if "feature_ts" in scored.columns else F.col("bar_ts")
    entry = F.when(F.col("side") == 1, F.col("hi_ref")).otherwise(F.col("lo_ref"))
    reach = F.col("side") * F.col("atr")
    return (
        scored.where(F.col("p_win") >= threshold)
        .select(
            *keep,
            "bar_ts",
            feature_ts.alias("feature_ts"),
            "side",
            entry.alias("entry"),
            (entry - reach * STOP_R).alias("stop"),
            (entry + reach * TARGET_R).alias("target"),
            "exp_p",
            "p_win",
        )
    )


def signal_text(rows: DataFrame) -> DataFrame:
    """Add ``text``, the readable form of a signal."""
    side = F.when(F.col("side") == 1, "LONG").otherwise("SHORT")
    text = F.format_string(
        "%s\nSide: %s\nEntry: %.2f\nStop: %.2f\nTarget: %.2f\nexp_p: %.3f\np_win: %.3f",
        F.date_format("bar_ts", "yyyy-MM-dd HH:mm:ss"),
        side, "entry", "stop", "target", "exp_p", "p_win",
    )
    return rows.withColumn("text", text)
