"""Structured Streaming operators (``streams``)."""
