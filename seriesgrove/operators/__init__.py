"""Operators: summaries, trees, search, training, calibration, allocation, reports."""
