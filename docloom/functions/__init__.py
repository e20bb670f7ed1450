"""Column functions that stay inside Catalyst."""
