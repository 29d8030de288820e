"""Query planning and the composed search pipeline."""
