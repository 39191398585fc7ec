"""Column functions of the disc formats."""
