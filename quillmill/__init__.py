"""quillmill: curation and evaluation of text datasets as lazy Spark plans."""
