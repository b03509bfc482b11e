"""Column functions over packet bytes and rendered values."""
