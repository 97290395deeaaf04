"""Document search, ranking and faceting as Spark plans."""
