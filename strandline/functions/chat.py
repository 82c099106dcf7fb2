"""A router of chat messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import strip, structure_kind

#: The router's patterns and word lists. The patterns are case-insensitive.
NUMBER = r"-?\d+(?:\.\d+)?"
LINK = r"(?:of|is|at|to|=|:|~|near|around|about|approximately|close\s+to)"
UNIT = r"(?:°\s*)?(k|kelvin|c|celsius|centigrade)\b"
NAMED_TARGET = rf"(?i)(?:\btg\b|glass[\s\-]transition(?:\s+temperature)?)\s*(?:{LINK}\s*)*({NUMBER})\s*(?:{UNIT})?"
UNIT_TARGET = rf"(?i)({NUMBER})\s*{UNIT}"
COUNT_NOUN = r"(?i)\b(\d+)\s+(?:polymers?|candidates?|structures?|molecules?|samples?|monomers?|repeat\s+units?|designs?|options?|suggestions?)\b"
COUNT_SET = r"(?i)\bn\s*(?:=|:)\s*(\d+)\b"
TEMPERATURE = rf"(?i)\b(?:temperature|temp)\b\s*(?:{LINK}\s*)*({NUMBER})"
TOP_P = rf"(?i)\btop[\s_\-]?p\b\s*(?:{LINK}\s*)*({NUMBER})"
TOP_K = rf"(?i)\btop[\s_\-]?k\b\s*(?:{LINK}\s*)*(\d+)"
SEED = rf"(?i)\bseed\b\s*(?:{LINK}\s*)*(\d+)"
HELP = r"^\s*(?:help|\?+|usage|commands?|options?)\s*[!.?]*\s*$"
HELP_PHRASES = ("what can you do", "what can i ask", "what do you do", "how do i use", "how does this work", "who are you", "what are you", "show me the commands")
GENERATE_VERBS = ("generate", "design", "make", "create", "produce", "propose", "suggest", "invent", "sample", "give me", "come up with")
PREDICT_VERBS = ("predict", "estimate", "what is", "what's", "whats", "compute", "calculate")


def to_kelvin(value: Column, unit: Column) -> Column:
    u = F.lower(F.trim(F.coalesce(unit, F.lit(""))))
    return F.when(u.isin("c", "celsius", "centigrade"), value + F.lit(273.15)).otherwise(value)


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    x = F.regexp_extract(text, pattern, group)
    return F.when(x != "", x)


def _without(text: Column, pattern: str) -> Column:
    """The text with the first place of a pattern blanked."""
    hit = F.regexp_extract(text, pattern, 0)
    at = F.call_function("locate", hit, text)
    return F.when((hit == "") | hit.isNull(), text).otherwise(F.concat(F.substring(text, F.lit(1), at - 1), F.lit(" "), F.substring(text, at + F.length(hit), F.length(text))))


def one_of(phrases: tuple[str, ...]) -> str:
    """A case-insensitive pattern of plain phrases."""
    return "(?i)" + "|".join(rf"\Q{p}\E" for p in phrases)


def route(df: DataFrame, message: str) -> DataFrame:
    """df with name, confidence, target (kelvin), count, structure, temperature, top_p, top_k, seed.
    Fixed order: help, then a structure (predict), a target (generate), bare knobs (params), unknown.
    What one rule has read is blanked for the next, so each step is a column of its own: as one nested
    expression it would double with every rule."""
    c = F.col
    keep = df.columns
    df = df.withColumn("__t", F.coalesce(c(message), F.lit("")))
    words = F.transform(F.split(strip(c("__t")), r"\s+"), lambda w: F.regexp_replace(w, r"^[?!,;:.]+|[?!,;:.]+$", ""))
    df = df.withColumn("__s", F.try_element_at(F.filter(words, lambda w: structure_kind(w).isNotNull()), F.lit(1)))
    df = df.withColumn("__r0", F.when(c("__s").isNotNull(), F.replace(c("__t"), c("__s"), F.lit(" "))).otherwise(c("__t")))
    df = df.withColumn("__named", F.regexp_extract("__r0", NAMED_TARGET, 0) != "")
    either = lambda k: F.when(c("__named"), _first(c("__r0"), NAMED_TARGET, k)).otherwise(_first(c("__r0"), UNIT_TARGET, k))
    df = df.withColumn("__target", to_kelvin(either(1).cast("double"), either(2)))
    df = df.withColumn("__r1", F.when(c("__named"), _without(c("__r0"), NAMED_TARGET)).otherwise(_without(c("__r0"), UNIT_TARGET)))
    df = df.withColumn("__noun", _first(c("__r1"), COUNT_NOUN)).withColumn("__set", _first(c("__r1"), COUNT_SET))
    df = df.withColumn("__r2", F.when(c("__noun").isNotNull(), _without(c("__r1"), COUNT_NOUN)).otherwise(_without(c("__r1"), COUNT_SET)))
    knobs = {"temperature": (TEMPERATURE, "double"), "top_p": (TOP_P, "double"), "top_k": (TOP_K, "long"), "seed": (SEED, "long")}
    df = df.withColumns({k: _first(c("__r2"), p).cast(t) for k, (p, t) in knobs.items()})
    is_help = F.lower("__t").rlike(HELP) | c("__t").rlike(one_of(HELP_PHRASES))
    name = F.when(strip(c("__t")) == "", "unknown").when(is_help, "help").when(c("__s").isNotNull(), "predict").when(c("__target").isNotNull(), "generate").when(F.coalesce(*[c(k).cast("string") for k in knobs]).isNotNull(), "params").otherwise("unknown")
    df = df.withColumn("name", name)
    confidence = (
        F.when(c("name") == "help", 1.0)
        .when(c("name") == "predict", F.when(c("__t").rlike(one_of(PREDICT_VERBS)), 0.95).otherwise(0.8))
        .when(c("name") == "generate", F.when(c("__t").rlike(one_of(GENERATE_VERBS)), 0.95).otherwise(0.7))
        .when(c("name") == "params", 0.9)
        .otherwise(0.0)
    )
    asked = c("name") == "generate"
    return df.select(*keep, "name", confidence.alias("confidence"), F.when(asked, c("__target")).alias("target"), F.when(asked, F.coalesce("__noun", "__set").cast("long")).alias("count"), F.when(c("name") == "predict", c("__s")).alias("structure"), *knobs)
