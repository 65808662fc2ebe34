"""Training-data operators: quality rules and classifier, language ID,
near-duplicates, mixing, packing, token output, sharding, chat rendering and
nearest neighbours.  Nothing outside this subpackage imports it."""
