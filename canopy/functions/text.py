"""Text expressions: comparison form, character error rate, line parts, redaction, ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cyrillic and Greek look-alikes and their Latin letters (fixed values).
LOOK_ALIKES = ("АВЕКМНОРСТХУІЈЅаеорсхуіјѕΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "ABEKMHOPCTXYIJSaeopcxyijsABEZHIKMNOPTYXo")


def normalize(text: Column) -> Column:
    """White space collapsed and trimmed, case kept; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def cer(pred: Column, truth: Column) -> Column:
    """Edit distance over the truth's length, at most 1; for an empty truth 0 if nothing was read, else 1."""
    p, g = normalize(pred), normalize(truth)
    return F.when(g == "", F.when(p == "", 0.0).otherwise(1.0)).otherwise(F.least(F.lit(1.0), F.levenshtein(p, g) / F.length(g)))


def redact(text: Column) -> Column:
    """Capitals to X, other letters to x, digits to 0; length, white space and signs stay."""
    out = F.regexp_replace(text, r"\p{Lu}", "X")
    out = F.regexp_replace(out, r"[\p{L}&&[^X]]", "x")
    return F.regexp_replace(out, r"\p{Nd}", "0")


def fold_look_alikes(text: Column) -> Column:
    """Look-alikes to Latin, only where the text is Latin once they are."""
    folded = F.translate(text, *LOOK_ALIKES)
    return F.when(folded.rlike(r"[A-Za-z]") & ~folded.rlike(r"[\p{L}&&[^\p{IsLatin}]]"), folded).otherwise(text)


def kebab(text: Column) -> Column:
    """camelCase, spaces and underscores to lower-case words joined by hyphens."""
    split = F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1-$2")
    return F.regexp_replace(F.lower(F.regexp_replace(split, r"[\s_]+", "-")), r"-+", "-")


def parse_px(text: Column, rem: float = 16.0) -> Column:
    """Number of pixels of ``12``, ``12px``, ``0.75rem`` or ``0.75em``; null if it is none of them."""
    number = F.regexp_extract(text, r"^\s*(-?[0-9]+(?:\.[0-9]+)?)\s*(px|rem|em)?\s*$", 1)
    unit = F.regexp_extract(text, r"^\s*(-?[0-9]+(?:\.[0-9]+)?)\s*(px|rem|em)?\s*$", 2)
    return F.when(number != "", number.cast("double") * F.when(unit.isin("rem", "em"), rem).otherwise(1.0))


def content_id(kind: str, *parts: Column) -> Column:
    """``kind-`` and the first ten hex digits of the SHA-1 of the parts joined by a unit separator."""
    return F.concat(F.lit(f"{kind}-"), F.substring(F.sha1(F.concat_ws("\x1f", *[p.cast("string") for p in parts])), 1, 10))


def text_parts(texts: DataFrame, key: list[str], column: str) -> DataFrame:
    """The whole of each text that is not blank (k -1, band 0 to 100) and, of several lines, each with its band in per cent."""
    t = texts.select(*key, F.col(column).alias("text"), F.split(column, "\n", -1).alias("a"))
    lines = t.select(*key, F.size("a").alias("n"), F.posexplode("a").alias("k", "line")).where((F.col("n") > 1) & (F.trim("line") != ""))
    lines = lines.select(*key, "k", (F.col("k") * 100.0 / F.col("n")).alias("y0"), ((F.col("k") + 1) * 100.0 / F.col("n")).alias("y1"), F.length("line").alias("chars"))
    whole = t.where(normalize(F.col("text")) != "").select(*key, F.lit(-1).alias("k"), F.lit(0.0).alias("y0"), F.lit(100.0).alias("y1"), F.length("text").alias("chars"))
    return lines.unionByName(whole)


def parse_variant(name: Column) -> Column:
    """``Style=Filled, State=Enabled`` as a map."""
    return F.str_to_map(F.regexp_replace(name, r"\s*,\s*", ","), F.lit(","), F.lit("="))


def project_variant(variant: Column, vocabulary: dict[str, list[str]]) -> Column:
    """The vocabulary's properties only, missing ones at their first value."""
    return F.create_map(*[x for k, values in vocabulary.items() for x in (F.lit(k), F.coalesce(variant[k], F.lit(values[0])))])
