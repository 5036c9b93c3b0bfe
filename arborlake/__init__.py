"""arborlake: Spark-first analytics over tree-structured 3-D point data."""
