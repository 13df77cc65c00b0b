"""Unicode clean-up of prompts with built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import patterns as P
from .memo import per_session

SANITIZED = ("normalized", "obfuscated", "obf_indicators", "removed")


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def present(labels: Column) -> Column:
    """The distinct labels that are not NULL, in order, without a lambda."""
    return F.array_except(labels, F.array(F.lit(None).cast("string")))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units, the unit in which prompt limits and spans are given."""
    return (
        F.when(is_ascii(text), F.char_length(text))
        .otherwise((F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int"))
    )


def widen_astral(text: Column) -> Column:
    """Stand two placeholder characters in for each character outside the BMP, so
    that a bounded `.{m,n}` counts UTF-16 units as it must."""
    return F.when(
        ~is_ascii(text), F.regexp_replace(text, F.lit(P.ASTRAL), F.lit("��"))
    ).otherwise(text)


def nfkc(text: Column, engine: str = "jvm", needed: Column | None = None) -> Column:
    """Compatibility normalisation (NFKC), applied where `needed` (default: where the
    text is not ASCII).

    Spark has no such function, but ships ICU: ``jvm`` calls its static composer and
    keeps the row inside the JVM.  ``arrow`` is the fallback for a Spark build
    without ICU; rows that need nothing then travel as NULL.
    """
    if needed is None:
        needed = ~is_ascii(text)
    if engine == "jvm":
        composed = F.java_method(
            F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True)
        )
        return F.when(needed, composed).otherwise(text)
    if engine == "arrow":
        from .arrow_nfkc import compose

        return F.coalesce(compose(F.when(needed, text)), text)
    raise ValueError(f"unknown NFKC engine: {engine!r}")


@per_session
def _stages(prompt: str, nfkc_engine: str) -> list[dict[str, Column]]:
    src = F.col(prompt)

    def count(char_class: str) -> Column:
        return F.when(
            F.col("_hidden"), F.regexp_count(src, F.lit(char_class))
        ).otherwise(F.lit(0))

    return [
        # No clean-up step touches a text without characters of this class.
        {"_odd": ~is_ascii(src) & src.rlike(P.MAY_CHANGE)},
        {"_hidden": F.col("_odd") & src.rlike(P.HIDDEN_CHARS)},
        {
            "_tags": count(P.TAG_CHARS),
            "_bidi": count(P.BIDI_CONTROL),
            "_zero": count(P.ZERO_WIDTH),
            "_stripped": F.when(
                F.col("_hidden"), F.regexp_replace(src, F.lit(P.HIDDEN_CHARS), F.lit(""))
            ).otherwise(src),
        },
        {"_nfkc": nfkc(F.col("_stripped"), nfkc_engine, F.col("_odd"))},
        {
            "_alike": F.col("_odd")
            & F.col("_nfkc").rlike(P.HOMOGLYPH_RANGE)
            & F.col("_nfkc").rlike(P.HOMOGLYPH_CLASS)
        },
        {
            "normalized": F.when(
                F.col("_alike"), F.translate("_nfkc", P.HOMOGLYPH_FROM, P.HOMOGLYPH_TO)
            ).otherwise(F.col("_nfkc")),
            "obf_indicators": F.when(
                F.col("_hidden") | F.col("_alike"),
                present(
                    F.array(
                        F.when(F.col("_tags") > 0, "tag_chars"),
                        F.when(F.col("_bidi") > 0, "bidi_control"),
                        F.when(F.col("_zero") > 0, "zero_width"),
                        F.when(F.col("_alike"), "homoglyph"),
                    )
                ),
            ).otherwise(F.array().cast("array<string>")),
            "obfuscated": F.col("_hidden") | F.col("_alike"),
            "removed": F.col("_tags") + F.col("_bidi") + F.col("_zero"),
        },
    ]


def sanitize(df: DataFrame, prompt: str = "prompt", nfkc_engine: str = "jvm") -> DataFrame:
    """Add `normalized`, `obfuscated`, `obf_indicators` and `removed`.

    Order: strip tag characters, bidi controls and zero-width characters, fold
    compatibility forms, then map look-alike letters.  Every step but the first test
    is skipped for text that no step can change.

    Filter on plain columns *before* this step: the ICU call is opaque to the
    optimizer, which does not move a later filter below it.
    """
    for stage in _stages(prompt, nfkc_engine):
        df = df.withColumns(stage)
    return df.drop("_odd", "_hidden", "_tags", "_bidi", "_zero", "_stripped", "_nfkc", "_alike")
