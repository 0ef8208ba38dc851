"""Composed jobs: the two comparisons and the register test, from operators."""
