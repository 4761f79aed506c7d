"""Streaming: the reference is batch only (no stream, time column or state), so no
streaming operator is built. Cross-table counts are additive; a later extension could
maintain them per micro-batch, but that is not part of the parity surface."""
