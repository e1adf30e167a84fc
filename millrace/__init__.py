"""millrace: documents to retrieval-ready tables, expressed as Spark plans."""
