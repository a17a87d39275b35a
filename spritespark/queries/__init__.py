"""The registered queries: operators applied to projections of the given tables, with their SQL oracles."""
