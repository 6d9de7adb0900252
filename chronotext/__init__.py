"""chronotext: timestamped-text analytics on Spark."""
