"""Structured Streaming forms of transitions that need timers or per-key state."""
