"""Training-corpus operators: archives, decontamination, quality, secrets, packing, deduplication, extraction, chat."""
