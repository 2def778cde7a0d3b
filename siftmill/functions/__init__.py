"""See the package docstring of siftmill."""
