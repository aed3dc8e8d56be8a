"""Column builders and small skew-safe building blocks shared by the operators."""
