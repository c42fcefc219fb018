"""Connected components, as all of the library computes them."""

from ..plans.components import components

__all__ = ["components"]
