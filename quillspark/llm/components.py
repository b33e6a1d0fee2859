"""Connected components of links, as the library has them."""

from quillspark.operators.graph import connected_components

__all__ = ["connected_components"]
