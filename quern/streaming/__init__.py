"""Structured Streaming jobs and event-log state queries."""
