"""Instrument master: which symbols are traded, and their tokens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import INDEX_SYMBOLS, UNIVERSE


def listed(
    exchange: Column, symbol: Column, kind: Column, *, on: str, of: str, symbols: Sequence[str]
) -> Column:
    """Listed on one exchange, of one kind, and in the symbol list."""
    return (exchange == on) & symbol.isin(*symbols) & (kind == of)


def contains(c: Column, part: str) -> Column:
    """Plain substring test; a missing text does not contain anything."""
    return F.coalesce(c.contains(part), F.lit(False))


def resolve_tokens(
    instruments: DataFrame,
    universe: Sequence[str] = tuple(UNIVERSE),
    index_symbols: Sequence[str] = tuple(INDEX_SYMBOLS),
    index_name: str = "NIFTY50",
    *,
    exchange: str = "NSE",
    kind: str = "EQ",
    index_segment: str = "INDICES",
) -> DataFrame:
    """``series, instrument_token`` of the universe and of the index."""
    equities = instruments.where(
        listed(
            F.col("exchange"), F.col("tradingsymbol"), F.col("instrument_type"),
            on=exchange, of=kind, symbols=universe,
        )
    ).select(F.col("tradingsymbol").alias("series"), "instrument_token")
    index = (
        instruments.where(
            F.col("tradingsymbol").isin(*index_symbols) & contains(F.col("segment"), index_segment)
        )
        .agg(F.min("instrument_token").alias("instrument_token"))
        .where(F.col("instrument_token").isNotNull())
        .select(F.lit(index_name).alias("series"), "instrument_token")
    )
    return equities.unionByName(index)


def lookup(rows: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Add a dimension's columns. Spark broadcasts the dimension when its size allows and
    shuffles both sides otherwise."""
    return rows.join(dimension, key, "inner")


def with_series(candles: DataFrame, tokens: DataFrame) -> DataFrame:
    """Name candles that carry a token."""
    return lookup(candles, tokens, "instrument_token")
