"""Code-risk analytics on Spark: findings, tasks, projects and their texts as DataFrames."""
