"""DataFrame operators: intervals, clocks, windows, joins, sampling, sets and evaluation."""
