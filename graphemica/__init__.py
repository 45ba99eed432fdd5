"""Character-set analytics on text corpora, as DataFrame programs."""

from .plans.session import ship

__all__ = ["ship"]
