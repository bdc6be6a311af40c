"""Training-data operators: near-duplicates, language, URL and quality
filters, secret scans, packing, extraction, toxicity, archives and
benchmark decontamination.  Nothing outside this subpackage imports it."""
