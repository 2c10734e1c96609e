"""Column expressions: numbers, positions, boxes, text."""
