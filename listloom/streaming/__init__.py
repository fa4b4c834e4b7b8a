"""The listing flow as Structured Streaming jobs."""
