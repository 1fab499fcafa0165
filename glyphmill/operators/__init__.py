"""Property search, derived tables, description trees, the variant graph and character documents."""
