"""DataFrame operators on keyed streams."""
