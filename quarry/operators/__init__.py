"""DataFrame operators: statistics, relational patterns, rules, clones, source metrics."""
