"""Structured Streaming: incremental rebuild of changed tiles."""
