"""Label fusion and corpus analytics as Spark DataFrame plans."""
