"""Training-data operators: cleaning, deduplication, search, archives, tokens.

Each module holds one operator with a general DataFrame interface. ``queries``
registers the thin digest queries over the test tables. Nothing outside this
folder (and ``corpus_pipeline.py``) imports it.
"""
