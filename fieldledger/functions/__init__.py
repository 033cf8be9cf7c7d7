"""functions of fieldledger."""
