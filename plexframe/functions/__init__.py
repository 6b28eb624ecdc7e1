"""Column builders: identity grammar, weights, normalisation, drawing arithmetic."""
