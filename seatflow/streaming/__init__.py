"""Event streams: decode, append, latest state, and the fill projection."""
