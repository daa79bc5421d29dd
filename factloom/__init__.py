"""factloom: versioned code facts on Spark."""
