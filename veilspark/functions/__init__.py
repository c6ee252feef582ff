"""Column builders: patterns, normal forms, lookups, cryptography."""
