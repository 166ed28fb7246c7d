"""Names, phones, organisations and recognised text as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfwise.functions import constants as K

_ACCENTS = "àáâãäåāăąçćčďèéêëēėęěìíîïīįıłľñńňòóôõöøōőŕřśšşťùúûüūůűųýÿźżž"
_PLAIN = "aaaaaaaaacccdeeeeeeeeiiiiiiillnnnoooooooorrssstuuuuuuuuyyzzz"


def normalize_phone(x: Column) -> Column:
    """Digits only; ten of them get the country digit, fewer than seven are null."""
    digits = F.regexp_replace(x, r"[^\p{Nd}]", "")
    return F.when(F.length(digits) == 10, F.concat(F.lit("1"), digits)).when(F.length(digits) >= 7, digits)


def normalize_name(x: Column) -> Column:
    """Lower case without accents, single blanks."""
    return F.trim(F.regexp_replace(F.translate(F.lower(x), _ACCENTS, _PLAIN), r"\s+", " "))


def expand_nicknames(x: Column) -> Column:
    """Every nickname of a folded name replaced by its name."""
    names = F.create_map(*[F.lit(v) for pair in K.NICKNAMES.items() for v in pair])
    return F.array_join(F.transform(F.split(x, " "), lambda t: F.coalesce(F.try_element_at(names, t), t)), " ")


def reverse_tokens(x: Column) -> Column:
    return F.array_join(F.reverse(F.split(x, " ")), " ")


def name_distance(a: str, b: str, limit: int | None = None) -> Column:
    """Least edit distance over plain, reversed and expanded forms (struct columns n, rn, e, re); null above the limit."""

    def d(x: str, y: str) -> Column:
        left, right = F.col(f"{a}.{x}"), F.col(f"{b}.{y}")
        if limit is None:
            return F.levenshtein(left, right)
        got = F.levenshtein(left, right, limit)
        return F.when(got >= 0, got)

    return F.least(d("n", "n"), d("rn", "n"), d("e", "e"), d("re", "e"))


def contains_any(x: Column, words: Iterable[str]) -> Column:
    out = None
    for w in words:
        out = x.contains(w) if out is None else out | x.contains(w)
    return out


def tag_screenshot(lines: Column) -> Column:
    """What a screenshot shows, by its recognised lines."""
    joined = F.lower(F.array_join(lines, " "))
    shown = F.length(F.replace(joined, F.lit(" "), F.lit("")))
    short = F.size(F.filter(lines, lambda s: F.length(s) < 50))
    return (
        F.when(contains_any(joined, K.RECEIPT), "Receipt").when(contains_any(joined, K.BOARDING), "Boarding Pass").when(contains_any(joined, K.COUPON), "Coupon / Code")
        .when((shown < 15) & (F.size(lines) > 0), "Meme").when(contains_any(joined, K.MEME), "Meme")
        .when((short > 5) & contains_any(joined, K.MESSAGING), "Conversation").otherwise("Other")
    )


def org_tokens(x: Column) -> Column:
    return F.filter(F.split(F.lower(x), r"[\s\p{Punct}]+"), lambda t: t != "")


def shared_filename(x: Column) -> Column:
    low = F.lower(F.coalesce(x, F.lit("")))
    return low.startswith("image") | (low.contains("-") & (F.length(low) > 30))
