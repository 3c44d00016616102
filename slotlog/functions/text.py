"""String rules: dirty values, code maps and keyword cascades."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotlog import constants as K


def recode(c: Column, mapping: dict[str, str]) -> Column:
    """Literal map; values outside it give null."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), c)


def not_nan(c: Column) -> Column:
    """The export writes missing text as ``nan``; the engine knows only null."""
    return F.when(c != "nan", c)


def is_number(c: Column) -> Column:
    """True for text that reads as a number; a trailing type letter (``12f``), which a cast would take, does not."""
    return c.try_cast("double").isNotNull() & ~c.rlike(r"[0-9.]\s*[dDfF]\s*$")


def numbers_only(c: Column) -> Column:
    return F.when(is_number(c), c)


def strip_float_suffix(c: Column) -> Column:
    return F.regexp_replace(c, r"\.0", "")


def strip_suffix(c: Column, suffix: str = K.PATIENT_ID_SUFFIX) -> Column:
    return F.replace(c, F.lit(suffix), F.lit(""))


def clamp_year(c: Column) -> Column:
    """Date text with a year beyond the limit gets the limit; the end-of-time mark becomes null."""
    year = F.regexp_extract(c, K.YEAR_PATTERN, 1)
    return (
        F.when(c == K.END_OF_TIME_TEXT, F.lit(None).cast("string"))
        .when((year != "") & (year.try_cast("int") > K.MAX_YEAR), F.replace(c, year, F.lit(str(K.MAX_YEAR))))
        .otherwise(c)
    )


def folded(c: Column) -> Column:
    """Text in lower case, with the two signs outside the alphabets that read as letters of it without regard to case."""
    return F.lower(F.translate(c, "\u017f\u212a", "sk"))


def occurs(folded_text: Column, pattern: str) -> Column:
    """Whether one of the alternatives of ``pattern`` occurs in a folded text.

    Words are searched as they are; ``^`` and ``$`` anchor at the ends. Only alternatives with a dot, which stands for any
    character, need a regular expression, one for all of them.
    """
    words, exact, starts, dotted = [], [], [], []
    for part in pattern.lower().split("|"):
        if "." in part:
            dotted.append(part)
        elif part.startswith("^"):
            (exact if part.endswith("$") else starts).append(part.strip("^$"))
        else:
            words.append(part)
    # A word is found with any shorter one inside it.
    words = [w for w in dict.fromkeys(words) if not any(x != w and x in w for x in words)]
    hits = [F.contains(folded_text, F.lit(w)) for w in words] + [F.startswith(folded_text, F.lit(w)) for w in starts]
    if exact:
        hits.append(folded_text.isin(exact))
    if dotted:
        hits.append(folded_text.rlike("|".join(dotted)))
    out = hits[0]
    for hit in hits[1:]:
        out = out | hit
    return out


def last_matching(folded_text: Column, rules: list[tuple[str, str]]) -> Column:
    """Label of the last rule whose pattern occurs in a folded text, else null."""
    out = None
    for pattern, label in reversed(rules):
        hit = occurs(folded_text, pattern)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out


def _with_label(df: DataFrame, column: str, name: str, label: Callable[[Column, Column], Column]) -> DataFrame:
    # The folded text is a column of its own, so that it is made once for all rules.
    return df.withColumn("folded__", folded(F.col(column))).withColumn(name, label(F.col(column), F.col("folded__"))).drop("folded__")


def add_modality(df: DataFrame, column: str, name: str = "modality") -> DataFrame:
    return _with_label(df, column, name, lambda c, t: F.coalesce(last_matching(t, K.MODALITY_RULES), F.lit("other")))


def add_occupation(df: DataFrame, column: str, name: str = "occupation") -> DataFrame:
    def label(c: Column, t: Column) -> Column:
        missing = c.isNull() | c.isin("nan", "-")
        return F.coalesce(last_matching(F.coalesce(t, F.lit("nan")), K.OCCUPATION_RULES), F.when(missing, "none_given"), F.lit("other"))

    return _with_label(df, column, name, label)


def add_reason(df: DataFrame, column: str, name: str = "reason") -> DataFrame:
    return _with_label(df, column, name, lambda c, t: F.when(c.isNull() | (c == "nan"), "none_given").otherwise(
        F.coalesce(last_matching(t, K.REASON_RULES), F.lit("other"))))


def reason_rank(c: Column) -> Column:
    """Any reason comes before none; among reasons the order of the rules decides."""
    order = {label: str(i) for i, (_, label) in enumerate(K.REASON_RULES)}
    order["other"] = str(len(order))
    order["none_given"] = str(len(order))
    return recode(c, order).cast("int")


def insurance_class(c: Column) -> Column:
    return F.coalesce(recode(c, K.INSURANCE_CLASS), F.lit("unknown"))


def marital(c: Column) -> Column:
    return F.when(c.isNull(), "not known").otherwise(F.coalesce(recode(c, K.MARITAL), F.lit("nan")))


def sex(c: Column) -> Column:
    return F.when(c == K.FEMALE, 1).otherwise(0).cast("long")
