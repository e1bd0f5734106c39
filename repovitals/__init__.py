"""Repository-health analytics over fact tables, as Spark DataFrame plans."""
