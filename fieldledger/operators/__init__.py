"""operators of fieldledger."""
