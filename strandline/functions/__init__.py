"""functions layer of the engine."""
