"""DataFrame -> DataFrame operators, one module per theme."""
