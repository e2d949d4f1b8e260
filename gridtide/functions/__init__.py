"""Column builders: scalar expressions and window expressions."""
