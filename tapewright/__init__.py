"""Bars, cross-section features, rolling features and signals as Spark DataFrame plans."""
