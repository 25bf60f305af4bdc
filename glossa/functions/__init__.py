"""glossa.functions."""
