"""Document governance over large corpora, expressed as Spark DataFrame operators."""
