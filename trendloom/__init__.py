"""Text trends, candidate phrases and a round-stamped property graph as DataFrame operations."""
