"""quillgraph: code-and-query lineage analytics as plain ``DataFrame -> DataFrame`` operators on PySpark."""
