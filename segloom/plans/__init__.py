"""Shared plan shapes on ordered sequences: islands, overlap, as-of and nearest joins, padded frames."""
