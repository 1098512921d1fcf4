"""DataFrame operators: bridges, facets, summaries, territory, quality checks."""
