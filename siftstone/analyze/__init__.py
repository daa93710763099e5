"""Analysis of one source file: names, rules, values. Pure Python, run inside Arrow batches."""
