"""noctua: batch jobs on Spark that clean and summarise collections of overnight sleep recordings."""
