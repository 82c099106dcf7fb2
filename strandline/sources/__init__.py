"""sources layer of the engine."""
