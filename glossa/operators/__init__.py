"""glossa.operators."""
