"""Graph of the engine."""
