"""Relational operators over peaks, samples, labels and windows."""
