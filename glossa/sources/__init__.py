"""glossa.sources."""
