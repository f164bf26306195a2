"""The five dimension texts of an article, as one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.config import DIMENSION_CUES, DIMENSIONS, FolioscopeError
from folioscope.functions import text as X
from folioscope.operators.ingest import content_hash

REQUIRED = (
    "article_id", "title", "title_normalized", "authors", "abstract", "keywords", "doi", "doi_normalized", "year",
    "source_title", "missing_abstract", "created_at", "updated_at",
)
LANGUAGES = ("auto", "es", "en", "multilingual")


def _choice(explicit: Column, extracted: Column, fallback: Column) -> Column:
    def pick(text: Column, source: str, confidence: float) -> Column:
        return F.struct(text.alias("text"), F.lit(source).alias("source"), F.lit(confidence).alias("confidence"))

    return (
        F.when(explicit != "", pick(explicit, "explicit", 1.0))
        .when(extracted != "", pick(extracted, "rule_based", 0.75))
        .otherwise(pick(fallback, "fallback", 0.35))
    )


def build_dimension_texts(articles: DataFrame, language: str = "auto", now: str | None = None) -> DataFrame:
    """Adds text, source and confidence of every dimension, and hashes the content anew.

    An explicit text comes first, then up to three sentences with a cue, then title,
    keywords and abstract.  ``language`` is recorded and changes nothing.
    """
    if language not in LANGUAGES:
        raise FolioscopeError("unknown_language", f"unknown language {language}")
    missing = [c for c in REQUIRED if c not in articles.columns]
    if missing:
        raise FolioscopeError("missing_column", f"missing columns: {', '.join(missing)}")
    for name in DIMENSIONS:
        if name not in articles.columns:
            articles = articles.withColumn(name, F.lit(""))
    # Each step is a column of its own, so that what several dimensions use is worked out once.
    out = articles.withColumns({f"_{c}": X.normalize_text(F.col(c)) for c in ("title", "keywords", "abstract")})
    out = out.withColumns({f"_said_{d}": X.normalize_text(F.col(d)) for d in DIMENSIONS})
    title, keywords, abstract = (F.col(f"_{c}") for c in ("title", "keywords", "abstract"))
    explicit = {d: F.col(f"_said_{d}") for d in DIMENSIONS}
    constructed = X.normalize_text(F.concat(title, F.lit(". "), keywords, F.lit(". "), abstract))
    theme = F.when(
        explicit["theme"] != "",
        F.struct(explicit["theme"].alias("text"), F.lit("explicit").alias("source"), F.lit(1.0).alias("confidence")),
    ).otherwise(F.struct(constructed.alias("text"), F.lit("constructed").alias("source"), F.lit(0.85).alias("confidence")))
    out = out.withColumns(
        {
            "_theme": theme,
            "_sentences": X.normalized_sentences(abstract),
            "_all_sentences": X.split_sentences(F.concat_ws(" ", title, abstract, keywords)),
        }
    )
    fallback = F.when(abstract != "", abstract).otherwise(F.col("_theme.text"))
    wide = F.when(abstract != "", X.normalize_text(F.concat_ws(" ", title, keywords, abstract))).otherwise(F.col("_theme.text"))
    found = {d: X.sentences_with(F.col("_all_sentences" if d == "context" else "_sentences"), cues) for d, cues in DIMENSION_CUES.items()}
    out = out.withColumns({f"_found_{d}": text for d, text in found.items()})
    for name in DIMENSION_CUES:
        out = out.withColumn(f"_{name}", _choice(explicit[name], F.col(f"_found_{name}"), wide if name == "context" else fallback))
    parts = {f"{d}_{p}": F.col(f"_{d}.{p}") for d in DIMENSIONS for p in ("text", "source", "confidence")}
    made = ["_title", "_keywords", "_abstract", "_sentences", "_all_sentences", *(f"{p}{d}" for d in DIMENSIONS for p in ("_", "_said_", "_found_"))]
    out = out.withColumns(parts).drop(*made)
    out = out.withColumn("dimension_language", F.lit(language))
    out = out.withColumn("updated_at", F.lit(now)) if now else out
    return out.withColumn("content_hash", content_hash(dimension_texts=True))
