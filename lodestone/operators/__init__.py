"""DataFrame operators: filters, ranking, graphs, listing, change feeds, metrics."""
