"""Structured Streaming: change feeds, digests, deadlines, repetition state, windows."""
