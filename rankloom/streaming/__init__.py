"""Structured Streaming replays."""
