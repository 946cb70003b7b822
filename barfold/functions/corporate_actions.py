"""Column expressions over corporate-action subject lines."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Wording and patterns of the exchange's subject lines.
DEAL_SPECIFIC_WORDS = ("debenture", "demerger", "merger", "scheme of arrangement", "amalgamat")
REVIEW_WORDS = ("bonus", "split", "sub-divi", "sub divi", "consolidat")
BONUS_PATTERN = r"(?i)bonus\D{0,15}?(\d+)\s*:\s*(\d+)"
FACE_FROM_PATTERN = r"(?i)from\s+rs\.?\s*(\d+(?:\.\d+)?)"
FACE_TO_PATTERN = r"(?i)to\s+r[se]\.?\s*(\d+(?:\.\d+)?)"


def _mentions(subject: Column, words: tuple[str, ...]) -> Column:
    return F.lower(subject).rlike("|".join(words))


def _captured(subject: Column, pattern: str, group: int) -> Column:
    text = F.regexp_extract(subject, pattern, group)
    return F.when(text != "", text).try_cast("double")


def _ratio(numerator: Column, denominator: Column, *positive: Column) -> Column:
    ok = F.lit(True)
    for p in positive:
        ok = ok & (p > 0)
    return F.when(ok, numerator / denominator)


def action_multiplier(subject: Column) -> Column:
    """Factor for prices strictly before the ex-date; null if not mechanical.

    A bonus x:y gives y/(x+y), a face-value change a -> b gives b/a, and a line
    announcing both multiplies them. Deal-specific events have no generic
    factor and stay null, as do lines with neither pattern.
    """
    new_shares, held_shares = (_captured(subject, BONUS_PATTERN, g) for g in (1, 2))
    face_old = _captured(subject, FACE_FROM_PATTERN, 1)
    face_new = _captured(subject, FACE_TO_PATTERN, 1)
    bonus = _ratio(held_shares, new_shares + held_shares, new_shares, held_shares)
    face = _ratio(face_new, face_old, face_old, face_new)
    found = (bonus.isNotNull() | face.isNotNull()) & ~_mentions(subject, DEAL_SPECIFIC_WORDS)
    return F.when(found, F.coalesce(bonus, F.lit(1.0)) * F.coalesce(face, F.lit(1.0)))


def needs_review(subject: Column) -> Column:
    """True where a share-count event is named but yields no multiplier."""
    return action_multiplier(subject).isNull() & _mentions(subject, REVIEW_WORDS)
