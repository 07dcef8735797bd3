"""Tables of captured user interfaces for Spark."""
