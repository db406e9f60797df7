"""Column functions over sets of facts."""
