"""From a search request to one DataFrame plan."""
