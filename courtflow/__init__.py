"""Court-sports tracking analytics as Spark DataFrame operators."""
