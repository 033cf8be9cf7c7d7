"""sources of fieldledger."""
