"""DataFrame operators over extents, ranges and trees."""
