"""Live endpointing with keyed state."""
