"""Clinical-data analytics and text preparation as Spark DataFrame operators."""
