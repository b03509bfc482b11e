"""Structured Streaming over live captures."""
