"""Structured Streaming: regenerate the graph snapshot when new files land."""

from .refresh import start_refresh  # noqa: F401
