"""Column functions over text, tokens, JSON and vectors."""
