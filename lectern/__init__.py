"""Revisioned speech transcripts, floor and speaker analytics on Spark."""
