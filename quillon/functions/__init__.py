"""Scalar functions and aggregates with the engine's exact semantics."""
