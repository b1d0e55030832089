"""Column-level building blocks: types, predicates, aggregates."""
