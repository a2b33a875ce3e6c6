"""Structured Streaming jobs: windowed metrics, de-duplication, keyed upserts."""
