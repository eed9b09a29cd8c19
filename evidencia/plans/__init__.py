"""plans of evidencia."""
