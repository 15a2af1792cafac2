"""DataFrame to DataFrame operators: filters, groups, similarity, keepers, actions, cache, history, metrics, corpora."""
