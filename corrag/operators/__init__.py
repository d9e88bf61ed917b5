"""DataFrame operators; each takes and returns DataFrames keyed by query or paper."""
