"""Training-data operators: token counts, sharding, near and exact-substring
deduplication, packing, media columns, nearest neighbours, language ID, source
mixing and toxicity.  Nothing outside this subpackage imports it."""
