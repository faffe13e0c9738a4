"""Training-data operators: search, language, toxicity, deduplication, sharding, tokenising, mixing.

Nothing outside this subpackage imports it.  Shared conventions:

* internal columns start with ``__lg_``; input columns of other names are never touched, so
  extra columns and clashing names are harmless;
* rows whose id is null take no part in comparisons and come back unchanged;
* intermediate tables are written below ``spark.checkpoint.dir`` (see ``common.Scratch``).
"""
