"""Payment reconciliation as set-wise Spark jobs over many accounts, channels and periods."""
