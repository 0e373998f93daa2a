"""Readers and writers: SCADA tables, weather files, backtest outputs, model registry."""
