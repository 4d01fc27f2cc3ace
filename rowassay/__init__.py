"""rowassay: data-quality profiling, scoring and version comparison as Spark DataFrame operators."""
