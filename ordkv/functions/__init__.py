"""Pure functions: key ranges and binary codecs."""
