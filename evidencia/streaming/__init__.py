"""streaming of evidencia."""
