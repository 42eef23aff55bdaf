"""Readers and writers for packets, corpora, feedback, models and metrics."""
