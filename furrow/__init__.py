"""Field, scene and chip analytics as Spark DataFrame operators."""
