"""Operators that prepare training data from transcripts and documents."""
