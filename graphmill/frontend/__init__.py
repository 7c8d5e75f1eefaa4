"""Source text to facts: tokens, syntax tree, symbols, scopes, references, edges. Pure Python, no Spark."""
