"""Structured Streaming over event tables: an addition, as the reference semantics are batch only."""
