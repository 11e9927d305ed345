"""Log analytics and data preparation as ordinary Spark plans."""
