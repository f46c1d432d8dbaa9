"""Article screening and fairness audit on Spark."""
