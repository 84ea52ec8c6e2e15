"""Table reconciliation and data validation as Spark jobs."""
