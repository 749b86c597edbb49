"""Structured Streaming: event-time windows, deduplication, state, and sinks into catalogue tables."""
