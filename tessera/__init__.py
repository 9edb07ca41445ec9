"""tessera: a Spark-first analytics engine for labelled text and code corpora."""
