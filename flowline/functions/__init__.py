"""Collectors: named aggregates over the rows of a flow."""

from .collectors import averaging, counting, joining, maximum, minimum, reducing, summing, to_list

__all__ = ["averaging", "counting", "joining", "maximum", "minimum", "reducing", "summing", "to_list"]
