"""sources of evidencia."""
