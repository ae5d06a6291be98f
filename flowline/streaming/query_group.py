"""Streaming queries that live and end together."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql.streaming import StreamingQuery

from ..operators.lifecycle import UpstreamError, composed


class QueryGroup:
    """A context in which queries are started; leaving it stops them all and runs what was registered to close with it.

    With ``on_failure`` a failed query is handed over and its siblings go on; without, the group stops and raises.
    """

    def __init__(self, on_failure: Callable[[StreamingQuery, BaseException], None] | None = None):
        self.on_failure, self.queries, self.closing, self.completing = on_failure, [], [], []

    def __enter__(self) -> QueryGroup:
        return self

    def add(self, query: StreamingQuery) -> StreamingQuery:
        self.queries.append(query)
        return query

    def also_close(self, close: Callable[[], None]) -> None:
        self.closing.append(close)

    def also_complete(self, complete: Callable[[], None]) -> None:
        """Called once all queries have ended without failure."""
        self.completing.append(complete)

    def await_all(self, timeout: float | None = None, poll: float = 0.2) -> bool:
        """Wait for all queries; False if time ran out."""
        end, failed = None if timeout is None else time.monotonic() + timeout, []
        waiting = list(self.queries)
        while waiting:
            for q in [q for q in waiting if not q.isActive]:
                waiting.remove(q)
                if (e := q.exception()) is not None:
                    failed.append(e)
                    if self.on_failure is None:
                        self.stop()
                        raise UpstreamError(str(e)) from e
                    self.on_failure(q, e)
            if end is not None and time.monotonic() > end:
                return False
            time.sleep(poll if waiting else 0)
        if not failed:
            composed(self.completing)
        return True

    def stop(self) -> None:
        composed([q.stop for q in self.queries if q.isActive])

    def __exit__(self, *exc) -> None:
        composed([self.stop, *reversed(self.closing)])
