"""Forecast, backtest and street-model jobs built from the operators."""
