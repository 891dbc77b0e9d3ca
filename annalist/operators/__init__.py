"""Operators on DataFrames: ranking, metrics, judges, results, efficiency, guidance, meta-evaluation."""
