"""Structured Streaming use of the row-local migration steps."""

from .replay import replay_stream, route_stream, run_to_table

__all__ = ["replay_stream", "route_stream", "run_to_table"]
