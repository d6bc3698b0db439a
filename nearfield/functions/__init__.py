"""Column functions over feature arrays."""
