"""Change-set operators."""
