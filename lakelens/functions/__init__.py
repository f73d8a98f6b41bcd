"""Column-expression helpers (type classes, hash predicates, path parsing)."""
