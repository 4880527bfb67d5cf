"""weftline: tabular and geographic transformations, written as Spark DataFrame jobs."""
