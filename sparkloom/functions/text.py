"""Text functions as column expressions. Case folding is `lower`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token and language patterns.
RETRIEVAL_TOKEN = r"[a-z][a-z0-9_+./-]*|[가-힣]{2,}|[0-9]+"
FEEDBACK_TOKEN = r"[0-9a-z가-힣]+"
PHRASE_TOKEN = r"[A-Za-z0-9]+|[가-힣]{2,}"
GENERIC_SYMPTOM_CHARS = r"[\p{L}\p{N}_@/.-]+"


def all_matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def retrieval_tokens(text: Column) -> Column:
    """Distinct lower-cased terms of two characters and more, in order."""
    return F.array_distinct(F.filter(all_matches(F.lower(text), RETRIEVAL_TOKEN), lambda t: F.length(t) >= 2))


def feedback_tokens(text: Column) -> Column:
    """Lower-cased terms with repeats."""
    return all_matches(F.lower(text), FEEDBACK_TOKEN)


def phrase_probes(text: Column) -> Column:
    return F.transform(all_matches(text, PHRASE_TOKEN), F.lower)


def symptom_tokens(text: Column) -> Column:
    return F.array_union(retrieval_tokens(text), F.filter(all_matches(F.lower(text), GENERIC_SYMPTOM_CHARS), lambda t: F.length(t) >= 2))


def content_tokens(text: Column, generic: list[str]) -> Column:
    """Symptom tokens without the generic ones."""
    return F.filter(symptom_tokens(text), lambda t: ~t.isin(generic))


def query_language(text: Column) -> Column:
    """ko, en, mixed or unknown; a Latin term of two letters makes Hangul text mixed."""
    hangul, latin = text.rlike("[가-힣]"), text.rlike("[A-Za-z]{2,}")
    return F.when(hangul & latin, "mixed").when(hangul, "ko").when(text.rlike("[A-Za-z]"), "en").otherwise("unknown")


def normalise_query(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def trimmed_sha1(text: Column) -> Column:
    return F.sha1(F.regexp_replace(text, r"^\s+|\s+$", "").cast("binary"))


def clip(text: Column, size: int) -> Column:
    """Blanks collapsed, cut to `size` characters with an ellipsis."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(flat) <= size, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, size - 3)), F.lit("...")))


def heading_slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^a-z0-9가-힣 _-]", ""), r" +", "-")


def redact(text: Column) -> Column:
    """E-mail addresses, bearer-like tokens and password assignments."""
    out = F.regexp_replace(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[email]")
    out = F.regexp_replace(out, r"[0-9a-f]{32,}", "[token]")
    return F.regexp_replace(out, r"(?i)(password|passwd|pwd)\s*[=:]\s*[^\s]+", "$1=[secret]")


def accents_folded(text: Column) -> Column:
    """Latin letters without their diacritics, for full-text matching."""
    return F.translate(F.lower(text), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def fts_tokens(text: Column) -> Column:
    """Whole tokens of letters and digits, folded."""
    return all_matches(accents_folded(text), r"[\p{L}\p{N}]+")


def candidate_id(path: Column, chunk: Column) -> Column:
    return F.concat(path.cast("string"), F.lit("#"), F.coalesce(chunk.cast("string"), F.lit("doc")))
