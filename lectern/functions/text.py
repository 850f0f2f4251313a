"""Text functions as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.config import BOILERPLATE, Knobs

#: A word character of any script.
W = r"[\p{L}\p{N}_]"
_NOT_W = r"[^\p{L}\p{N}_]"
#: A term of five characters or more; hyphens stand inside only.
TERM = rf"{W}[\p{{L}}\p{{N}}_-]{{3,}}{W}"


def norm(word: Column) -> Column:
    """Lower case, word characters only: what must agree for two words to be the same."""
    return F.regexp_replace(F.lower(word), _NOT_W, "")


def tokens(text: Column) -> Column:
    """Non-empty tokens between white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def norm_tokens(text: Column) -> Column:
    return F.filter(F.transform(tokens(text), norm), lambda w: w != "")


def tidy(text: Column) -> Column:
    """Single spaces, none before punctuation, none at the ends."""
    return F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), r"\s+([,.!?;:…])", "$1")


def ends_sentence(text: Column) -> Column:
    return text.rlike(r"""[.!?…]+[»"')\]]*$""")


def is_degenerate(text: Column) -> Column:
    """Six tokens or more, of two kinds at most or with a pair four times in a row.

    The text is cleaned once as a whole, and the pair is found by one pattern.
    """
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), rf"[^\p{{L}}\p{{N}}_\s]", ""), r"\s+", " "))

    def repeats(c):
        few = F.exists(F.array(F.split(c, " ")), lambda t: (F.size(t) >= 6) & (F.size(F.array_distinct(t)) <= 2))
        return c.rlike(r"(?:^| )(\S+ \S+)(?: \1){3}(?: |$)") | few

    return F.exists(F.array(clean), repeats)  # bound in a lambda, the clean text is made once


def verdict(text: Column, no_speech: Column, logprob: Column, compression: Column, knobs: Knobs = Knobs(), phrases=BOILERPLATE) -> Column:
    """Why a decoded text is not speech, or null. Phrases count only where the sound is in doubt."""
    t = F.trim(text)
    doubt = (no_speech >= knobs.marginal_no_speech) | (logprob <= knobs.logprob)
    known = F.lit(False)
    for phrase in phrases:
        known = known | t.rlike("(?iu)" + phrase)
    return (
        F.when(t == "", "empty")
        .when(no_speech >= knobs.no_speech, "no_speech")
        .when(compression >= knobs.compression, "compression")
        .when(is_degenerate(t), "degenerate")
        .when(doubt & known, "boilerplate")
    )


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), F.lit(1))


def topic(talk: Column, lang: Column) -> Column:
    return F.concat_ws(":", F.lit("talk"), talk.cast("string"), F.lit("lang"), lang)


def control_topic(talk: Column) -> Column:
    return F.concat_ws(":", F.lit("talk"), talk.cast("string"), F.lit("ctl"))


def glossary_pattern(terms: list[str]) -> str:
    """Whole words, any case, longer terms first."""
    escaped = sorted((re.escape(t) for t in terms), key=len, reverse=True)
    return rf"(?iu)(?<!{W})({'|'.join(escaped)})(?!{W})"


def protect(text: Column, pattern: str) -> Column:
    """(masked, found): each match of the pattern replaced by §i§ in turn, and the matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    between = F.split(text, pattern, -1)
    marks = F.transform(found, lambda _, i: F.format_string("§%d§", i))
    masked = F.array_join(F.flatten(F.zip_with(between, marks, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    return F.struct(masked.alias("masked"), found.alias("found"))


def restore(masked: Column, found: Column, targets: Column) -> Column:
    """Marks replaced by the term's target (a map by term), looked up as found, then in lower case, else as found."""
    pick = lambda w: F.coalesce(F.try_element_at(targets, w), F.try_element_at(targets, F.lower(w)), w)
    pairs = F.transform(found, lambda w, i: F.struct(F.format_string("§%d§", i).alias("mark"), pick(w).alias("word")))
    return F.aggregate(pairs, masked, lambda text, p: F.replace(text, p["mark"], p["word"]))
