"""Choice of the best extraction per document."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ENOUGH = 0.85


def _confidence(words: Column) -> Column:
    return F.round(F.least(F.lit(1.0), words / 450), 2)


def choose_extraction(native_words: Column, ocr_words: Column, best_richness: Column,
                      model_richness: Column) -> Column:
    """struct(method, confidence) among native text, OCR and a model's record (null: not run).

    ``best_richness`` is the richness of the native/OCR winner; the model's record replaces it
    only when strictly richer, and is not asked at all when confidence is already enough.
    """
    native = _confidence(native_words)
    ocr_wins = (ocr_words > native_words * 1.10) & (ocr_words >= 150)
    use_ocr = F.when(ocr_wins, True).when(native_words >= 150, False).otherwise(ocr_words >= native_words)
    best = F.when(ocr_wins, _confidence(ocr_words)).when(native_words >= 150, native).otherwise(
        _confidence(F.greatest(native_words, ocr_words)))

    def pick(method, confidence):
        return F.struct(F.lit(method).alias("method"), confidence.alias("confidence"))

    fallback = F.when(use_ocr & (ocr_words >= 30), pick("ocr", best)).when(
        native_words >= 30, pick("pdfplumber", native)).otherwise(pick("pdfplumber", F.lit(0.0)))
    return (F.when(native >= ENOUGH, pick("pdfplumber", native))
            .when((best >= ENOUGH) & use_ocr, pick("ocr", best))
            .when(best >= ENOUGH, pick("pdfplumber", best))
            .when(model_richness > best_richness, pick("vision_llm", F.lit(0.95)))
            .otherwise(fallback))
