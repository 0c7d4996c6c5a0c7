"""The indicator operators that hold on unbounded input."""
