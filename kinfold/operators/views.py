"""Token views of normalised records: what the similarity joins look records up by."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import tokens


def prefixed(prefix: str, a: Column) -> Column:
    return F.transform(a, lambda t: F.concat(F.lit(prefix), t))


def bigrams(prefix: str, a: Column) -> Column:
    """Adjacent pairs; an array of fewer than two tokens has none."""
    n = F.size(a)
    pairs = F.zip_with(F.slice(a, F.lit(1), n - 1), F.slice(a, F.lit(2), n - 1), lambda x, y: F.concat(F.lit(prefix), x, F.lit("_"), y))
    return F.when(n >= 2, pairs).otherwise(F.array().cast("array<string>"))


def address_tokens(words: str) -> Column:
    """Street words and pairs, numbers, the first two numbers with the first two words, and the city."""
    w, nums, city = tokens(F.col(words)), tokens(F.col("addr_nums")), F.col("addr_city")
    crossed = F.flatten(F.transform(F.slice(nums, 1, 2), lambda n: F.transform(F.slice(w, 1, 2), lambda x: F.concat(F.lit("D:"), n, F.lit("_"), x))))
    return F.concat(prefixed("a:", w), bigrams("A:", w), prefixed("d:", nums), crossed, F.when(city != "", F.array(F.concat(F.lit("c:"), city))).otherwise(F.array().cast("array<string>")))


def view_combo() -> Column:
    core, skel, city = tokens(F.col("name_core")), tokens(F.col("name_skel")), F.col("addr_city")
    placed = F.when((city != "") & (F.size(core) > 0), F.array(F.concat(F.lit("C:"), city, F.lit("_"), F.get(core, F.lit(0))))).otherwise(F.array().cast("array<string>"))
    return F.concat(prefixed("n:", core), bigrams("N:", core), prefixed("s:", F.filter(skel, lambda t: F.length(t) > 1)), placed, address_tokens("addr_street_words"))


def view_address() -> Column:
    """Words as written and by skeleton; what both have (numbers, city) counts twice."""
    return F.concat(address_tokens("addr_street_words"), prefixed("k:", address_tokens("addr_skel")), prefixed("d:", tokens(F.col("addr_nums"))))


def view_skeleton() -> Column:
    skel, nospace = tokens(F.col("name_skel")), F.col("name_nospace")
    start = F.when(nospace != "", F.array(F.concat(F.lit("p:"), F.substring(nospace, 1, 6)))).otherwise(F.array().cast("array<string>"))
    return F.concat(prefixed("s:", skel), bigrams("S:", skel), start, prefixed("k:", address_tokens("addr_skel")))


def char_ngrams(c: Column, n: int = 3) -> Column:
    """n-grams of a text padded by a blank on either side."""
    padded = F.concat(F.lit(" "), c, F.lit(" "))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - n + 1, F.lit(1))), lambda i: F.substring(padded, i, F.lit(n)))
    return F.when(c != "", grams).otherwise(F.array().cast("array<string>"))


def view_name_char() -> Column:
    return F.concat(char_ngrams(F.col("name_nospace")), address_tokens("addr_street_words"))


@dataclass(frozen=True)
class Retriever:
    """A token view, how many partners a record gets by it, and how frequent a token may be (none: as frequent as it is)."""

    name: str
    view: Callable[[], Column]
    k: int = 20
    max_df: int | None = 5000

    def keeping(self, k: int) -> Retriever:
        return replace(self, k=k)


RETRIEVERS = {r.name: r for r in (Retriever("combo", view_combo), Retriever("skel", view_skeleton), Retriever("addr", view_address), Retriever("char", view_name_char))}
