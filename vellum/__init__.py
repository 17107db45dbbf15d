"""Analytics over noisy text corpora and the trade records beside them, on Spark DataFrames."""
