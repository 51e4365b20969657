"""Training-data operators: near-duplicate search, scans, scoring, sharding and packing.

Nothing outside this folder imports it; ``corpus_pipeline.py`` and the query registry in
``queries.py`` are its only users.
"""
