"""corpusmill: web-page tables to Markdown corpora, as Spark DataFrame operators."""
