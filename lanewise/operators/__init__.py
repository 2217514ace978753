"""DataFrame operators: cleaning, resampling, rollups, joins, windows and metrics."""
