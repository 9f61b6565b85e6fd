"""Files, addresses, bytes and settings in; documents out."""
