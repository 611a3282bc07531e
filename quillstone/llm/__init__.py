"""Training-data operators: dedup, decontamination, packing, language, licences, privacy, quality."""
