"""Training-data operators: decontamination, deduplication, formatting, privacy, licences, scoring, sampling, rules and id files."""
