"""Plans as DataFrames: evaluation, normalisation and adjoints."""
