"""streaming of fieldledger."""
