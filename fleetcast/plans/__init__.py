"""Compositions of operators: backtests, learned models, calibration reports."""
