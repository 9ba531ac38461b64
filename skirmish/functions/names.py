"""What is left of a player's name without clan tags and decorations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of the two rulesets, with their replacements, in the order in which they apply.
CLAN_RULES = [
    (r"^[•·]+\s*", ""), (r"\s*[•·]+$", ""),
    (r"^\[.*?\]\s*", ""), (r"^\].*?\[\s*", ""), (r"^\(.*?\)\s*", ""), (r"^\{.*?\}\s*", ""),
    (r"\s*\[.*?\]$", ""), (r"\s*\(.*?\)$", ""), (r"\s*\{.*?\}$", ""),
    (r"^\d+\.\s*", ""),
    (r"(?i)^\.[a-z0-9]{1,6}\.\s*", ""), (r"(?i)\s*\.[a-z0-9]{1,6}\.$", ""),
    (r"(?i)^-[a-z0-9]{1,6}-\s*", ""), (r"(?i)\s*-[a-z0-9]{1,6}-$", ""),
    (r"(?i)\s*=[a-z0-9]{1,6}=\s*$", ""), (r"(?i)^=[a-z0-9]{1,6}=\s*", ""),
    (r"(?i)\.{2,}[a-z]+$", ""), (r"(?i)\|gf\d*$", ""), (r"(?i)•[a-z0-9]{1,5}$", ""), (r"(?i)^d2•", ""), (r"^>>\s*", ""),
    (r"^\d+\.\s+", ""), (r"^\(\d+\)\s*", ""),
    (r"(?i)^x{1,2}([a-z]{2,})", "$1"), (r"(?i)([a-z]{2,})x{1,2}$", "$1"),
    (r"(?i)[_\s]*(afk|away|idle|spec)$", ""),
    (r"^[._\-=\[\]{}<>|*^()\s/]+", ""), (r"[._\-=\[\]{}<>|*^()\s]+$", ""),
]
EXPLORE_RULES = [
    (r"^[•·._\-=\[\]{}<>|*^()\s]+", ""), (r"[•·._\-=\[\]{}<>|*^()\s]+$", ""),
    (r"^\[.*?\]\s*", ""), (r"^\].*?\[\s*", ""), (r"^\(.*?\)\s*", ""), (r"^\{.*?\}\s*", ""),
    (r"\s*\[.*?\]$", ""), (r"\s*\(.*?\)$", ""), (r"\s*\{.*?\}$", ""),
    (r"^\d+\.\s*", ""),
    (r"(?i)^\.[a-z0-9]{1,6}\.\s*", ""), (r"(?i)\s*\.[a-z0-9]{1,6}\.$", ""),
    (r"(?i)^-[a-z0-9]{1,6}-\s*", ""), (r"(?i)\s*-[a-z0-9]{1,6}-$", ""),
    (r"(?i)^=[a-z0-9]{1,6}=\s*", ""), (r"(?i)\s*=[a-z0-9]{1,6}=$", ""),
    (r"(?i)\.{2,}[a-z]+$", ""), (r"^\d+\.\s+", ""), (r"^\(\d+\)\s*", ""),
    (r"(?i)^x{1,2}([a-z])", "$1"), (r"(?i)([a-z])x{1,2}$", "$1"),
    (r"(?i)[_\s]*(afk|away|idle|spec)$", ""),
    (r"^[•·._\-=\[\]{}<>|*^()\s]+", ""), (r"[•·._\-=\[\]{}<>|*^()\s]+$", ""),
]


def core_name(name: Column, rules: list[tuple[str, str]] = CLAN_RULES) -> Column:
    """A normalised name without what the rules take off, digits read as the letters that they stand for."""
    name = F.trim(name)
    for pattern, instead in rules:
        name = F.regexp_replace(name, pattern, instead)
    return F.trim(F.lower(F.translate(name, "013457$", "oieasts")))
