"""Column expressions (tiers, order keys) used by the operators."""
