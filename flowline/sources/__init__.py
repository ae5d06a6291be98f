"""Where flows come from and where they go."""

from .sinks import batches_to, collect_list, for_each, rows_to
from .sources import from_callable, from_frame, from_rows, one_shot

__all__ = ["batches_to", "collect_list", "for_each", "from_callable", "from_frame", "from_rows", "one_shot", "rows_to"]
