"""Operations of a training-data pipeline: archives, identifiers, languages, fingerprints, dedup, mixing, decontamination, toxicity.

Nothing outside this subpackage imports it. Every operator takes and returns DataFrames and keeps to these rules:
the input may hold nulls, empty and very long texts, repeated rows and extra columns; no result depends on the order
of rows or on the number of partitions; what one task or the driver holds is bounded by a documented parameter.
"""
