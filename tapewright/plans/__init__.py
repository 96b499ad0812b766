"""Operators put together: feature frame, scoring, signals, back-fill."""
