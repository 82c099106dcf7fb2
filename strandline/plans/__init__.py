"""plans layer of the engine."""
