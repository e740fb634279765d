"""factloom: compile records into queryable tables and answer ranked questions on Spark."""
