"""See the package docstring of lexmill."""
