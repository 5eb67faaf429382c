"""Column functions: tokens, vocabularies, draws and vectors."""
