"""DataFrame → DataFrame operators (encoding, counting, scoring, structure, CPTs, sampling, evaluation)."""
