"""Column expressions: arrays, times, text and scores."""
