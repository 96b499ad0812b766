"""DataFrame operators: bars, blocks, windows, cross-section, alignment, history."""
