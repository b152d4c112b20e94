"""Operators over DataFrames: apportionment and mixing, statistics, joins over time and coverage, sampling and batching, manifest validation."""
