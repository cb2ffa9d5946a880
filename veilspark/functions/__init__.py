"""Column expressions: keyed draws, value domains, generators, redaction, text helpers."""
