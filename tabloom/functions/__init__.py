"""Column expressions: cleaning of cells, normal scores, hashed uniforms, test p-values."""
