"""Text functions: folding, tokens, phrases, UTF-16 lengths and slices, excerpts."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from daybook.functions.redact import SPACE

#: Letters, numbers and private-use characters make up a token.
TOKEN = r"[\p{L}\p{N}\p{Co}]+"
EXCERPT, LEAD = 320, 80


@lru_cache(maxsize=1)
def _accents() -> tuple[str, str]:
    """Lower-case letters that are one base letter and marks, and their base letters."""
    pairs = []
    for c in map(chr, range(0xC0, 0x2000)):
        parts = unicodedata.normalize("NFD", c)
        if c == c.lower() and len(parts) > 1 and not unicodedata.combining(parts[0]) and all(unicodedata.category(p).startswith("M") for p in parts[1:]):
            pairs.append((c, parts[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(text: Column) -> Column:
    """Lower case without diacritics."""
    return F.regexp_replace(F.translate(F.lower(text), *_accents()), r"\p{M}+", "")


def fold_str(text: str) -> str:
    """fold() of a request's own words, by the same table: what isn't in it (kana, Hangul) stays as it is composed."""
    folded = text.lower().translate(str.maketrans(*_accents()))
    return "".join(c for c in folded if not unicodedata.category(c).startswith("M"))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def let(value: Column, use) -> Column:
    """use(value) with value evaluated once, also where the optimizer copies the whole expression into a filter."""
    return F.element_at(F.transform(F.array(value), use), 1)


def phrases(query: str) -> list[tuple[str, ...]]:
    """A request's phrases: each white-space separated word, as the runs of letters and numbers in it, folded. Words
    that are equal as typed count once; words that only fold alike count each."""
    found = {}
    for word in unicodedata.normalize("NFC", query).split():
        runs = re.findall(r"[^\W_]+", word)
        if runs:
            found.setdefault(" ".join(runs), tuple(fold_str(r) for r in runs))
    return list(found.values())


def phrase_count(tk: Column, phrase: tuple[str, ...]) -> Column:
    """How often the phrase's tokens stand in order side by side; instances may overlap."""
    if len(phrase) == 1:
        return F.size(F.filter(tk, lambda x: x == phrase[0]))
    n, whole = len(phrase), F.array(*[F.lit(p) for p in phrase])
    starts = F.when(F.size(tk) >= n, F.sequence(F.lit(1), F.size(tk) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.when(F.array_contains(tk, phrase[0]), F.size(F.filter(starts, lambda i: F.slice(tk, i, n) == whole))).otherwise(0)


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def utf16_slice(text: str, start: int, length: int) -> str:
    """A slice of a page's own text in UTF-16 units; half a surrogate pair at either end is replaced."""
    return text.encode("utf-16-le", "surrogatepass")[2 * start : 2 * (start + length)].decode("utf-16-le", "replace")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def flat(text: Column) -> Column:
    """White space collapsed to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, rf"[{SPACE}]+", " "))


def first_place(text: Column, terms: list[str]) -> Column:
    """The smallest place (from 0) at which any folded term occurs in the folded text; 0 if none does."""
    at = [F.locate(t, fold(text)) - 1 for t in terms]
    places = F.filter(F.array(*at), lambda p: p >= 0) if at else F.array().cast("array<int>")
    return F.coalesce(F.array_min(places), F.lit(0))


def excerpt(text: Column, query: str | None = None) -> Column:
    """A window of ``EXCERPT`` UTF-16 units around the first term of the query. A surrogate pair that the window's end
    would cut is left out of it."""
    terms = [fold_str(t) for t in re.findall(r"[^\W_]+", query or "")]

    def window(start: Column) -> Column:
        rest = F.substring(text, start + 1, F.lit(EXCERPT))
        # Each character beyond the basic plane takes two units, so the window has that many characters fewer.
        units = F.transform(F.split(rest, ""), lambda c: F.when(F.octet_length(c) == 4, 2).otherwise(1))
        fitting = F.aggregate(units, F.struct(F.lit(0).alias("u"), F.lit(0).alias("n")), lambda a, u: F.struct((a["u"] + u).alias("u"), (a["n"] + F.when(a["u"] + u <= EXCERPT, 1).otherwise(0)).alias("n")))["n"]
        length = F.when(F.length(rest) * 2 == utf16_length(rest) + F.length(rest), F.length(rest)).otherwise(fitting)
        return let(length, lambda n: F.concat(F.when(start > 0, "…").otherwise(""), flat(F.substring(rest, F.lit(1), n)), F.when(start + n < F.length(text), "…").otherwise("")))

    return let(F.greatest(F.lit(0), first_place(text, terms) - LEAD), window)
