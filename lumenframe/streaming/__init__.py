"""Streaming forms of batch operators."""
