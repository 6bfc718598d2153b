"""Plan-level building blocks: distributed ranks, skew-proof joins, connected components."""

from .components import connected_components
from .ranking import ranked
from .skew import salted_join, star_join

__all__ = ["connected_components", "ranked", "salted_join", "star_join"]
