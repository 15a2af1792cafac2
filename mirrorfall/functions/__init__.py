"""Column expressions: paths, glob patterns, exclusion packs, keeper scores, bits and hashes."""
