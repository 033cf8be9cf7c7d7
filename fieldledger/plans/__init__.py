"""plans of fieldledger."""
