"""Structured Streaming jobs. Each batch step is the batch operator; each write is idempotent per batch."""
