"""Operators of a training-data pipeline (decontamination, near duplicates, quality,
PII, token counts, licences, classifier, SentencePiece, sharding, token files).

Nothing outside this package imports it; ``__spark_entry__.py`` adds its queries
when the package is present."""
