"""File-arrival ingestion and windowed aggregation on Structured Streaming."""
