"""Column builders and DataFrame building blocks shared by the operators."""
