"""streaming layer of the engine."""
