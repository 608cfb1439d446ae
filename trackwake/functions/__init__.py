"""Column functions: text shapes, point geometry and track arrays."""
