"""Training-data operators on Spark: near-duplicates, sharding, archives, quality, extraction,
search, decontamination, tokenisation and license scans.

Nothing outside this subpackage imports it (``__spark_entry__`` adds its queries when present).
"""
