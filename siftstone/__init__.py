"""siftstone: code findings as DataFrames, and the generic operators behind them."""
