"""Panel operators: pure ``DataFrame -> DataFrame`` functions."""
