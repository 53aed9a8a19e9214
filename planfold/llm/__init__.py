"""Training-data operators: filtering, deduplication, mixing and tokenised output over whole corpora."""
