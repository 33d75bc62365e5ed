"""Structured Streaming form of answering."""
