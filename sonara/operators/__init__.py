"""Operators over score curves, signals, token sequences, words and transcripts."""
