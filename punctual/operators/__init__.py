"""Building blocks that need more than one DataFrame step."""
