"""Relational operators and the predicates they take."""
