"""veritext: trustworthy text from web pages, and corpora, as Spark DataFrames."""
