"""Domain analytics built from the operators."""
