"""cohortframe: sample-aware differential analytics and corpus preparation on PySpark."""
