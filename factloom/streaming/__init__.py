"""Facts that arrive in batches."""
