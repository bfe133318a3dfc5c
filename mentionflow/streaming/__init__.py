"""Bounded-memory linking and incremental hierarchies, in batch and Structured Streaming."""
