"""Online updates by Structured Streaming."""
