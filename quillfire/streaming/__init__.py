"""Collections kept up to date from a change feed."""
