"""rowloom: table verbs, sources and sinks expressed as Spark DataFrame plans."""
