"""Log analytics on Spark: text logs to one typed relation, and operators over it."""
