"""Search, knowledge-graph and time analytics over collections of notes, on Spark."""
