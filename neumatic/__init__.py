"""Analytics over corpora of digitised sheet music, written with Spark's DataFrame API."""
