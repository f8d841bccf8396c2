"""Column expressions: timestamps, line shapes, tokens, template slots, JSON text."""
