"""Training-data operators: line dedup, secret and licence scans, BPE, packing, n-gram
Jaccard join, quality rules, token counts, syncmer fingerprints, chat formatting, tokenizer
alignment, importance resampling and ring sharding.

Nothing else in the library imports this package.  Every operator selects the columns it
needs under its own names first, so extra columns of its input never clash.
"""
