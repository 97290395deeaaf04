"""Operators: matching, filtering, ranking, facets and typo correction."""
