"""Text of the engine."""
