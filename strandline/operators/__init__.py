"""operators layer of the engine."""
