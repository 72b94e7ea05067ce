"""Normalised views of names and addresses, as Column expressions."""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as lx

# ---- fixed values: the patterns that decide what is cleaned away -------------------------------------
DOMAIN = r"\b(?:https?://)?(?:www\.)?([a-z0-9][a-z0-9-]*)\.(?:co\.in|com|net|org|in|co|fr|biz|info|us|io)\b"
BOX_NUMBER = r"\b(?:pmb|po box|p o box|box)\s*\d+\b"
DEGREE_NUMBER = r"\bn\s?deg\s?\d*\b"
NUMBER_SUFFIX = r"\b(\d+)\s+(?:bis|ter|quater|[a-qs-z])\b(?=\s|$)"
ORDINAL = r"^\d+(?:st|nd|rd|th)$"
# ------------------------------------------------------------------------------------------------------


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*map(F.lit, chain.from_iterable(table.items())))


def _looked_up(table: dict[str, str], t: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(table), t), t) if table else t


def _in(t: Column, words) -> Column:
    return t.isin(list(words))


def tokens(c: Column) -> Column:
    """Words between blanks; none for an empty text."""
    return F.filter(F.split(c, " +"), lambda t: t != "")


def basic_clean(c: Column) -> Column:
    c = F.replace(F.replace(F.replace(c, F.lit("&"), F.lit(" and ")), F.lit("+"), F.lit(" and ")), F.lit("@"), F.lit(" at "))
    c = F.regexp_replace(c, "(?<=[a-z])['`’](?=[a-z])", "")
    c = F.regexp_replace(c, r"(?<=\b[a-z])\.(?=\s?[a-z]\b)", "")
    c = F.regexp_replace(c, r"[^a-z0-9/\- ]+", " ")
    c = F.replace(F.replace(c, F.lit(" - "), F.lit(" ")), F.lit(" / "), F.lit(" "))
    return F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"^[ \-/]+|[ \-/]+$", "")


def join_single_letters(c: Column) -> Column:
    return F.regexp_replace(c, r"(?<=\b[a-z]) (?=[a-z]\b)", "")


def collapse_repeats(a: Column) -> Column:
    return F.filter(a, lambda x, i: (i == 0) | (x != F.get(a, i - 1)))


def _squeezed(t: Column) -> Column:
    return F.regexp_replace(t, r"(.)\1+", "$1")


def _without_later_vowels(t: Column) -> Column:
    return F.concat(F.substring(t, 1, 1), F.regexp_replace(F.substring(t, 2, 1 << 20), "[aeiou]", ""))


def skeleton(t: Column) -> Column:
    """Consonant key of a token that vowels and spelling habits don't change; digits stay."""
    s = t
    for old, new in (("ph", "f"), ("x", "ks"), ("q", "k"), ("ck", "k"), ("c", "k"), ("w", "v"), ("z", "j"), ("y", "i")):
        s = F.replace(s, F.lit(old), F.lit(new))
    s = _squeezed(_without_later_vowels(F.regexp_replace(s, "([bdgjkprstv])h", "$1")))
    return F.when(t.rlike(r"^\d*$"), t).otherwise(s)


def loose_key(t: Column) -> Column:
    """Key by sound: voicing, aspiration and vowels don't count."""
    s = t
    for old, new in (("ght", "t"), ("sh", "s"), ("ch", "s"), ("ph", "p"), ("x", "ks")):
        s = F.replace(s, F.lit(old), F.lit(new))
    s = F.replace(F.regexp_replace(s, "c(?=[eiy])", "s"), F.lit("c"), F.lit("k"))
    s = F.translate(F.regexp_replace(s, "g(?=[ei])", "s"), "bvwfdgqjzyh", "pppptkkss")
    head = F.when(F.substring(s, 1, 1).rlike("[aeiou]"), F.lit("a")).otherwise(F.substring(s, 1, 1))
    s = _squeezed(F.concat(head, F.regexp_replace(F.substring(s, 2, 1 << 20), "[aeiou]", "")))
    return F.when(t.rlike(r"^\d*$"), t).otherwise(s)


def loose_skeleton(core: Column) -> Column:
    return F.array_join(F.filter(F.transform(tokens(core), loose_key), lambda k: k != ""), " ")


def fix_ocr(t: Column) -> Column:
    mixed = t.rlike("[a-z]") & t.rlike(r"\d") & ~t.rlike(ORDINAL)
    return F.when(mixed, F.translate(t, "1053", "lose")).otherwise(t)


def unwrap_domain(c: Column) -> Column:
    return F.regexp_replace(c, DOMAIN, " $1 ")


def is_domain(c: Column) -> Column:
    return c.rlike(DOMAIN)


def numbers(c: Column) -> Column:
    """All digit runs without leading zeros."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1)), lambda n: F.regexp_replace(n, "^0+(?=[0-9])", ""))


def distinctive(core: Column, noise: list[str] | None = None) -> Column:
    """A name without single letters and the noise words, as ``mining.mine_noise`` finds them for a country or for all."""
    return F.array_join(F.filter(tokens(core), lambda t: (F.length(t) > 1) & ~t.isin(noise or [])), " ")


def script(c: Column) -> Column:
    """ascii, latin-accents or non-latin."""
    return F.when(c.rlike(r"^\p{ASCII}*$"), "ascii").when(c.rlike(r"^[\x{0}-\x{24f}\x{1e00}-\x{206f}\x{20a0}-\x{2122}]*$"), "latin-accents").otherwise("non-latin")


def normalize_name(ascii_name: Column, country: Column, aliases: dict[str, str] | None = None) -> dict[str, Column]:
    """The name views of an ASCII-folded name.  aliases: mined spellings, variant to canonical."""
    s = F.regexp_replace(unwrap_domain(ascii_name), r"\bln(?=[bcdfghjkmnpqrstvwxz])", "in")
    s = F.regexp_replace(join_single_letters(basic_clean(s)), "[-/]", " ")
    s = reduce(lambda c, p: F.regexp_replace(c, rf"\b{p[0]}\b", p[1]), lx.LEGAL_PHRASES, s)
    toks = F.transform(tokens(s), fix_ocr)
    toks = F.transform(toks, lambda t: _looked_up(aliases or {}, _looked_up(lx.NAME_WORDS, t)))
    by_sound = F.transform(toks, lambda t: F.when(~_in(t, lx.LEGAL) & (F.length(t) > 4), F.coalesce(F.try_element_at(_map(lx.LEGAL_SKELETONS), skeleton(t)), t)).otherwise(t))
    words = tokens(F.array_join(F.transform(by_sound, lambda t: _looked_up(lx.LEGAL, t)), " "))
    legal = F.filter(words, lambda t: _in(t, lx.LEGAL_FORMS))
    land = F.lower(F.trim(country))
    core = F.filter(words, lambda t: ~_in(t, lx.LEGAL_FORMS) & (t != land) & (t != "and"))
    return {"__words": words, "__legal": legal, "__core": core}


def name_views(words: Column, legal: Column, core: Column) -> dict[str, Column]:
    core = collapse_repeats(core)
    return {
        "name_clean": F.array_join(words, " "),
        "name_core": F.array_join(core, " "),
        "name_legal": F.array_join(F.array_sort(F.array_distinct(legal)), " "),
        "name_sorted": F.array_join(F.array_sort(F.array_distinct(core)), " "),
        "name_nospace": F.array_join(core, ""),
        "name_skel": F.array_join(F.transform(core, skeleton), " "),
    }


def contextual(a: Column) -> Column:
    """Tokens in which st and dr read as saint and doctor where they open a name."""

    def read(t: Column, i: Column) -> Column:
        after, before = F.coalesce(F.get(a, i + 1), F.lit("")), F.coalesce(F.get(a, i - 1), F.lit(""))
        opens = after.rlike("^[a-z]+$") & ~_in(after, lx.STREET) & ((before == "") | before.rlike(r"^\d+$") | _in(before, lx.STREET))
        return F.when(_in(t, ["saint", "sainte"]) | (_in(t, lx.SAINTS) & opens), "saint").when((t == "dr") & opens, "doctor").otherwise(t)

    return F.transform(a, read)


def code_regions(c: Column, country: Column) -> Column:
    """Region names of the country as their codes, longer names first."""
    out = c
    for land, table in lx.REGIONS.items():
        coded = reduce(lambda x, p: F.regexp_replace(x, rf"\b{p[0]}\b", p[1]), sorted(table.items(), key=lambda p: -len(p[0])), c)
        out = F.when(country == land, coded).otherwise(out)
    return out


def address_parts(ascii_address: Column, country: Column, aliases: dict[str, str] | None = None) -> Column:
    """Cleaned comma components as arrays of tokens, placeholders dropped."""
    s = F.regexp_replace(F.regexp_replace(ascii_address, BOX_NUMBER, " "), DEGREE_NUMBER, " ")
    parts = F.transform(F.split(code_regions(s, country), ","), lambda c: join_single_letters(F.regexp_replace(basic_clean(c), NUMBER_SUFFIX, "$1")))
    parts = F.filter(parts, lambda c: (c != "") & ~_in(c, lx.NOTHING))
    words = F.transform(parts, lambda c: F.filter(F.transform(contextual(tokens(c)), lambda t: _looked_up(aliases or {}, F.coalesce(F.try_element_at(_map(lx.CITIES), t), F.try_element_at(_map(lx.STREET), t), t))), lambda t: ~_in(t, lx.NOTHING)))
    return F.filter(words, lambda a: F.size(a) > 0)


def address_views(parts: Column, country: Column) -> dict[str, Column]:
    codes = F.array().cast("array<string>")
    for land, table in lx.REGIONS.items():
        codes = F.when(country == land, F.array(*map(F.lit, sorted(set(table.values()))))).otherwise(codes)
    clean = F.array_join(F.flatten(parts), " ")
    nums = numbers(clean)
    words = F.filter(F.split(clean, r"[\s/\-]+"), lambda t: (t != "") & ~t.rlike(r"^\d+$"))
    street = F.filter(words, lambda t: ~_in(t, lx.STREET_CANON) & ~F.array_contains(codes, t) & ~t.rlike(ORDINAL))
    lines = [w for w in lx.STREET_CANON if w not in ("n", "s", "e", "w", "near", "opp")]
    named = F.transform(parts, lambda a: F.filter(a, lambda t: ~t.rlike(r"^\d+$")))

    def is_city(a: Column) -> Column:
        whole = F.array_join(a, " ")
        return (F.size(a) > 0) & ~F.array_contains(codes, whole) & (whole != F.lower(F.trim(country))) & ~_in(F.get(a, F.lit(0)), lx.LANDMARKS) & ~F.arrays_overlap(a, F.array(*map(F.lit, lines))) & ~whole.rlike(r"\d")

    city = F.coalesce(F.array_join(F.try_element_at(F.filter(named, is_city), F.lit(-1)), " "), F.lit(""))
    return {
        "addr_clean": clean,
        "addr_nums": F.array_join(nums, " "),
        "addr_first_num": F.coalesce(F.get(nums, F.lit(0)), F.lit("")),
        "addr_words": F.array_join(words, " "),
        "addr_street_words": F.array_join(street, " "),
        "addr_city": city,
        "addr_skel": F.array_join(F.transform(street, skeleton), " "),
    }
