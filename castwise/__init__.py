"""Co-occurrence and plot-dynamics analytics on Spark."""
