"""Knowledge-graph and corpus analytics expressed as Spark DataFrame plans."""
