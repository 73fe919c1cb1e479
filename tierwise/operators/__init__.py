"""DataFrame operators, one module per tier of the engine."""
