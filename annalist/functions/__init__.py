"""Column functions: years, sets of years, durations, labels, text and JSON."""
