"""Training-data operators: decontamination, language id, near-duplicates, mixing, PII, URL rules, LM and toxicity scores."""
