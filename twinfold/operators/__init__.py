"""DataFrame operators: tensors, factors, normal equations, solve, updates, predict."""
