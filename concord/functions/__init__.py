"""Column builders: text, numbers, fingerprints and row formulas."""
