"""Flows over unbounded input: stateful boundaries with timers, and groups of running queries."""

from .processors import stream_boundary, stream_flow
from .query_group import QueryGroup

__all__ = ["QueryGroup", "stream_boundary", "stream_flow"]
