"""Operators that prepare training text at scale, each by its own stated method."""
