"""Surrogates for personal data and secrets.  DataFrame operations only.

**Finding.** Entities are found in one pass of one pattern, a group a kind (``KINDS``).  Persons are found behind a title or in a context that names one
("Contact: ...").  In a text that has any, a second pattern, made of their names, finds every further mention: without title, in part, as a possessive, in capitals.

**Coreference.** A person's entity is the full name, whatever the title; a mention in part stands for the first full name of its text that has all its words, and gets those
words' part of the surrogate.  Its gender is that of the titles: of those in its text, and over the corpus where texts differ (none if they contradict each other).
Other kinds have a normal form (letters lower-cased, punctuation dropped where it doesn't count).  The same entity has the same surrogate wherever and however it stands.
Two persons of one full name can't be told apart, and a part of a name is tied to a full name within one text only.

**Surrogates.** The normal form is hashed with a secret key, and the surrogate is made from the hash: digit for digit, letter for letter (hexadecimal for hexadecimal),
with country codes, card schemes, key prefixes, valid octets and check digits (cards, IBANs) kept as the kind has them.  An email has the surrogate of its domain, which is an
entity of its own.  A person's surrogate has the gender, the name's script and as many names; an address keeps its kind of street.  Each mention is written in its own layout.

**Collisions** are checked over the whole corpus: two entities of a kind must not share a surrogate, and no surrogate may be an entity of the corpus.
The smallest entity of a clash keeps its surrogate, the others draw again with the next counter, until none is left.  Names and mailboxes grow with the counter,
so they can't run out; kinds of a fixed format that has fewer surrogates than there are entities raise an error.  Surrogates of counter 0 are recomputed where they are needed,
so only those that drew again travel, to the texts that have them.

Texts are read and searched once, and staged as what is found and what is between.  Null texts stay null and have no entity.  Texts without an entity are unchanged, byte for byte.
Repeated rows give repeated rows, no rows none.  All other columns are kept, whatever their names.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage

# Titles by gender, and given names by gender and script.
TITLES = {
    "f": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Mme", "Madame", "Mlle", "Mademoiselle", "Sra", "Srta", "Señora", "Señorita", "Signora", "г-жа", "Госпожа", "Κυρία"],
    "m": ["Mr", "Mister", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Signor", "г-н", "Господин", "Κύριος"],
    "n": ["Dr", "Prof", "Professor", "Mx"],
}
GIVEN = {
    "latin": {"f": ["Anna", "Clara", "Helen", "Irene", "Julia", "Laura", "Marta", "Nora", "Paula", "Vera"], "m": ["Adam", "Bruno", "David", "Hugo", "Ivan", "Jonas", "Martin", "Oscar", "Paul", "Victor"], "n": ["Alex", "Charlie", "Chris", "Jordan", "Kim", "Noa", "Robin", "Sam", "Sascha", "Toni"]},
    "cyrillic": {"f": ["Анна", "Вера", "Елена", "Ирина", "Мария", "Нина", "Ольга", "Софья"], "m": ["Антон", "Борис", "Виктор", "Иван", "Михаил", "Олег", "Павел", "Роман"], "n": ["Саша", "Женя", "Валя", "Слава"]},
    "greek": {"f": ["Άννα", "Ελένη", "Ειρήνη", "Μαρία"], "m": ["Γιώργος", "Ιωάννης", "Νίκος", "Πέτρος"], "n": ["Αλεξ", "Κιμ"]},
}
# Syllables of made-up family names, by script.
SYLLABLES = {
    "latin": ["ba", "be", "bo", "da", "de", "do", "fa", "fe", "ga", "go", "ka", "ke", "ko", "la", "le", "li", "lo", "ma", "me", "mi", "mo", "na", "ne", "ni", "no", "pa", "pe", "po", "ra", "re", "ri", "ro", "sa", "se", "si", "so", "ta", "te", "ti", "to", "va", "ve", "vi", "wa"],
    "cyrillic": ["ба", "бе", "бо", "ва", "ве", "го", "да", "де", "до", "ка", "ко", "ла", "ле", "ло", "ма", "ми", "мо", "на", "не", "но", "па", "по", "ра", "ре", "ро", "са", "со", "та", "те", "то"],
    "greek": ["βα", "γα", "δε", "δο", "κα", "κο", "λα", "λε", "μα", "μι", "να", "νο", "πα", "πο", "ρα", "ρο", "σα", "τα", "τε", "το"],
}
# Small words inside names, contexts that name a person, kinds of streets, and small words in streets.
PARTICLES = ["van", "von", "der", "den", "de", "da", "di", "del", "della", "dos", "la", "le", "bin", "ter", "zu"]
CONTEXTS = ["Contact", "Contact person", "Name", "Full name", "Customer", "Client", "Patient", "Employee", "Applicant", "Author", "Signed", "Signed by", "Attn", "Attention", "Recipient", "Sender", "Kontakt", "Ansprechpartner", "Kunde", "Nom", "Contacto", "Nombre", "Cliente"]
PHRASES = ["Dear", "my name is", "My name is", "I am called", "Ich heiße", "ich heiße", "Mein Name ist", "mein Name ist", "Je m'appelle", "je m'appelle", "Me llamo", "me llamo", "Mi nombre es", "mi nombre es"]
STREETS = ["street", "avenue", "road", "lane", "drive", "boulevard", "court", "square", "terrace", "crescent", "rue", "chemin", "impasse", "calle", "avenida", "plaza", "paseo"]
COMPOUNDS = ["straße", "strasse", "weg", "platz", "allee", "gasse"]
STREET_WORDS = ["de", "la", "du", "des", "del", "los", "las"]


def _any(words: list[str]) -> str:
    return "|".join(sorted(words, key=len, reverse=True))


_TITLE = _any([t for ts in TITLES.values() for t in ts])
_NAME = r"\p{Lu}[\p{L}'’\-]+"
_MORE = rf"(?: (?:(?:{_any(PARTICLES)}) ){{0,2}}{_NAME})"
_CAPITAL = "|".join(w.capitalize() for w in STREETS)
#: Kind and pattern.  Where two match at one place the first counts.  No groups but those that don't capture.
KINDS = {
    "secret": r"(?=[AgsxpPtTaS])(?:AKIA[0-9A-Z]{16}(?![0-9A-Za-z])|(?:ghp_|sk-|xox[abp]-)[0-9A-Za-z\-]{16,}|(?i:password|passwd|pwd|token|secret|api_?key)\s{0,3}[=:]\s{0,3}[\"']?[0-9A-Za-z_\-+/]{8,}[\"']?)",
    "email": r"[\p{L}0-9._%+\-]++@[\p{L}0-9\-]+(?:\.[\p{L}0-9\-]+)*\.\p{L}{2,}",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "ip": r"(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
    "card": r"[3-6][0-9]{3}(?:[ \-]?[0-9]{4}){2}[ \-]?[0-9]{1,7}(?![0-9])",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])",
    "phone": r"\+[0-9]{1,3}(?:[ .\-]?\(?[0-9]{2,5}\)?){2,5}(?![0-9])|\([0-9]{3}\) ?[0-9]{3}[ .\-][0-9]{4}(?![0-9])|[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4}(?![0-9])",
    "person": rf"(?=[\p{{Lu}}г])(?:(?:{_TITLE})\.? {_NAME}{_MORE}{{0,2}}|(?<=(?:{_any(CONTEXTS)}): |(?:{_any(PHRASES)}) ){_NAME}{_MORE}{{1,2}})",
    "address": rf"[0-9]{{1,5}}[A-Za-z]?,? (?:{_NAME} ){{1,3}}(?:{_CAPITAL})(?![\p{{L}}])|[0-9]{{1,5}},? (?:rue|avenue|boulevard|chemin|impasse)(?: (?:{_any(STREET_WORDS)})){{0,2}} {_NAME}(?: {_NAME}){{0,2}}|(?=\p{{Lu}})(?:(?:Calle|Avenida|Plaza|Paseo)(?: (?:{_any(STREET_WORDS)})){{0,2}} {_NAME}(?: {_NAME}){{0,2}},? [0-9]{{1,4}}|\p{{Lu}}\p{{L}}+(?:{_any(COMPOUNDS)}) [0-9]{{1,4}}[a-z]?)(?![\p{{L}}0-9])",
}
_EDGE = r"(?<![\p{L}0-9_@])"
PATTERN = _EDGE + "(?:" + "|".join(f"({p})" for p in KINDS.values()) + ")"
_SEP = "\u001f"
#: Marks around a mention, between its groups, and for either in a text (all noncharacters, which no text should have; one that does is put right again).
_S, _T, _E = "﷐", "﷑", "﷒"
_ESCAPES = [(_E, _E + "﷕"), (_S, _E + "﷓"), (_T, _E + "﷔")]
_GROUPS = _S + _T.join(f"${i + 1}" for i in range(len(KINDS))) + _S
_POSSESSIVE = "['’]s?$"


def _escaped(text: Column) -> Column:
    out = text
    for plain, code in _ESCAPES:
        out = F.replace(out, F.lit(plain), F.lit(code))
    return F.when(text.contains(_E) | text.contains(_S) | text.contains(_T), out).otherwise(text)


def _unescaped(text: Column) -> Column:
    out = text
    for plain, code in reversed(_ESCAPES):
        out = F.replace(out, F.lit(code), F.lit(plain))
    return F.when(text.contains(_E), out).otherwise(text)


def _marked_kind(x: Column) -> Column:
    """The kind of a mention, given as its groups with marks between them."""
    return F.element_at(F.array(*map(F.lit, KINDS)), F.length(x) - F.length(F.ltrim(x, F.lit(_T))) + 1)


def _title(e: Column) -> Column:
    return F.regexp_extract(e, rf"^({_TITLE})\.? ", 1)


def _words(e: Column) -> Column:
    """The words of a person's name, in lower case, without title and possessive ending."""
    return F.transform(F.split(F.regexp_replace(e, rf"^(?:{_TITLE})\.? ", ""), " "), lambda w: F.lower(F.regexp_replace(w, _POSSESSIVE, "")))


def _gender(f: Column, m: Column) -> Column:
    return F.when(f & ~m, F.lit("f")).when(m & ~f, F.lit("m")).otherwise(F.lit("n"))


def _with_names(parts: Column) -> Column:
    """Parts of a text (what is between, mention, what is between, ...) with the further mentions of the persons that are among the mentions."""
    tag = _T * list(KINDS).index("person")
    persons = F.filter(parts, lambda x, i: (i % 2 == 1) & (_marked_kind(x) == "person"))
    bare = F.transform(persons, lambda x: F.regexp_replace(F.replace(x, F.lit(_T), F.lit("")), rf"^(?:{_TITLE})\.? ", ""))
    words = F.array_distinct(F.transform(F.flatten(F.transform(bare, lambda x: F.split(x, " "))), lambda w: F.regexp_replace(w, _POSSESSIVE, "")))
    words = F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(PARTICLES))
    words = F.reverse(F.array_sort(F.array_union(words, F.transform(words, F.upper)), lambda a, b: F.length(a) - F.length(b)))
    some = F.concat(F.lit("(?:\\Q"), F.array_join(words, "\\E|\\Q"), F.lit("\\E)(?![\\p{L}0-9_])"))
    again = F.concat(F.lit(f"{_EDGE}("), some, F.lit(f"(?: (?:(?:{_any(PARTICLES)}) ){{0,2}}"), some, F.lit(")*)"))
    tail = _T * (len(KINDS) - 1 - list(KINDS).index("person"))
    marked = F.transform(parts, lambda x, i: F.when(i % 2 == 1, F.concat(F.lit(_S), x, F.lit(_S))).otherwise(F.regexp_replace(x, again, F.lit(f"{_S}{tag}$1{tail}{_S}"))))
    return F.when(F.size(words) > 0, F.split(F.array_join(marked, ""), _S, -1)).otherwise(parts)


def _split(text: Column) -> Column:
    parts = F.split(F.regexp_replace(_escaped(text), F.lit(PATTERN), F.lit(_GROUPS)), _S, -1)
    return parts


def _has_person(parts: Column) -> Column:
    return F.exists(F.transform(parts, lambda x, i: (i % 2 == 1) & (_marked_kind(x) == "person")), lambda b: b)


def _mentions(parts: Column) -> Column:
    return F.transform(F.filter(parts, lambda x, i: i % 2 == 1), lambda x: F.struct(F.replace(x, F.lit(_T), F.lit("")).alias("e"), _marked_kind(x).alias("kind")))


def _plain_mentions(parts: Column) -> Column:
    """Mentions in order (e, kind, norm) of a text without persons."""
    return F.transform(_mentions(parts), lambda x: F.struct(x["e"].alias("e"), x["kind"].alias("kind"), normal_form(x["kind"], x["e"]).alias("norm")))


def _resolved_mentions(parts: Column) -> Column:
    """Mentions in order (e, kind, norm) of a text with persons."""
    own = F.transform(_mentions(parts), lambda x: F.struct(x["e"].alias("e"), x["kind"].alias("kind"), F.when(x["kind"] == "person", _words(x["e"])).alias("words"), _title(x["e"]).alias("title")))
    names = F.array_distinct(F.transform(F.filter(own, lambda x: F.size(x["words"]) > 1), lambda x: F.array_join(x["words"], " ")))

    def entity(x):
        """The full name that a mention stands for: its own, else the first that has all its words, else what there is of it."""
        whole = F.array_join(x["words"], " ")
        having = F.filter(names, lambda n: F.size(F.array_except(x["words"], F.split(n, " "))) == 0)
        return F.when(F.array_contains(names, whole) | (F.size(having) == 0), whole).otherwise(F.get(having, F.lit(0)))

    told = F.transform(own, lambda x: F.struct(x["e"].alias("e"), x["kind"].alias("kind"), F.when(x["kind"] == "person", entity(x)).alias("name"), x["title"].alias("title")))
    has = lambda x, g: F.exists(told, lambda y: (y["name"] == x["name"]) & y["title"].isin(TITLES[g]))
    norm = lambda x: F.when(x["kind"] == "person", F.concat(_gender(has(x, "f"), has(x, "m")), F.lit(_SEP), x["name"])).otherwise(normal_form(x["kind"], x["e"]))
    return F.transform(told, lambda x: F.struct(x["e"].alias("e"), x["kind"].alias("kind"), norm(x).alias("norm")))


def _head(kind: Column, e: Column) -> Column:
    """The part of a mention that is kept as it is: a title, a key's prefix, a country code."""
    return (
        F.when(kind == "person", F.regexp_extract(e, rf"^(?:{_TITLE})\.? ", 0))
        .when(kind == "secret", F.regexp_extract(e, r"^(?:AKIA|ghp_|sk-|xox[abp]-|(?i:password|passwd|pwd|token|secret|api_?key)\s{0,3}[=:]\s{0,3}[\"']?)", 0))
        .when(kind == "phone", F.regexp_extract(e, r"^\+(?:1|7|[0-9]{2})(?![0-9]{4})|^\+(?:1|7|[0-9]{2})", 0))
        .when(kind == "iban", F.substring(e, 1, 2))
        .when(kind == "card", F.substring(e, 1, 1))
        .otherwise(F.lit(""))
    )


def normal_form(kind: Column, e: Column) -> Column:
    """Equal for mentions of one entity of any kind but persons: its kind's head and its own letters and digits."""
    head = _head(kind, e)
    body = F.substring(e, F.length(head) + 1, F.length(e))
    plain = F.when(kind == "email", F.lower(body)).when(kind == "address", F.lower(F.replace(body, F.lit(","), F.lit("")))).when(kind == "secret", F.regexp_replace(body, "[\"']", "")).when(kind == "ip", body).when(kind == "iban", F.regexp_replace(body, "[^0-9A-Z]", "")).otherwise(F.regexp_replace(body, "[^0-9]", ""))
    front = F.when(kind == "secret", F.regexp_replace(F.lower(head), "[^a-z0-9]", "")).when(kind == "phone", F.regexp_replace(head, "[^0-9]", "")).otherwise(head)
    return F.concat(front, F.lit(_SEP), plain)


def _draw(seed: Column, i: Column | int, n: int) -> Column:
    return F.pmod(F.xxhash64(seed, F.lit(i) if isinstance(i, int) else i), F.lit(n)).cast("int")


def _pick(letters: str, seed: Column, i: Column) -> Column:
    return F.substring(F.lit(letters), _draw(seed, i, len(letters)) + 1, F.lit(1))


def _chars(plain: Column, seed: Column, hexadecimal: Column | None = None) -> Column:
    """Letter for letter, digit for digit; a digit that isn't 0 stays so."""
    low, up, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    as_hex = F.lit(False) if hexadecimal is None else hexadecimal

    def one(c: Column, i: Column) -> Column:
        return (
            F.when(c.between("1", "9"), F.when(as_hex, _pick(digit, seed, i)).otherwise(_pick(digit[1:], seed, i)))
            .when(c == "0", _pick(digit, seed, i))
            .when(c.between("a", "z"), F.when(as_hex, _pick(low[:6], seed, i)).otherwise(_pick(low, seed, i)))
            .when(c.between("A", "Z"), F.when(as_hex, _pick(up[:6], seed, i)).otherwise(_pick(up, seed, i)))
            .when(F.lower(c) != F.upper(c), F.when(c == F.lower(c), _pick(low, seed, i)).otherwise(_pick(up, seed, i)))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(plain, ""), one), "")


def _luhn(digits: Column) -> Column:
    """Sum of the check, over the digits from the right, the last counted once."""
    values = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((2 * c.cast("int")) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(values, F.lit(0), lambda s, x: s + x) % 10


def _iban_check(country: Column, body: Column) -> Column:
    """The two check digits for an account number."""
    text = F.concat(body, country, F.lit("00"))
    numbers = F.transform(F.split(text, ""), lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55))
    rest = F.aggregate(numbers, F.lit(0), lambda s, x: F.when(x > 9, s * 100 + x).otherwise(s * 10 + x) % 97)
    return F.lpad((98 - rest).cast("string"), 2, "0")


def _family(script: str, seed: Column, i: Column, counter: Column) -> Column:
    """A made-up name of four syllables, and one more for every fourth draw."""
    syllables = F.array(*map(F.lit, SYLLABLES[script]))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4) + F.floor(counter / 4).cast("int")), lambda k: F.element_at(syllables, _draw(seed, i * 100 + k, len(SYLLABLES[script])) + 1)), "")


def _by_script(plain: Column, build) -> Column:
    return F.when(plain.rlike(r"\p{IsCyrillic}"), build("cyrillic")).when(plain.rlike(r"\p{IsGreek}"), build("greek")).otherwise(build("latin"))


def _person(plain: Column, gender: Column, seed: Column, counter: Column) -> Column:
    parts = F.split(plain, " ")

    def given(script: str) -> Column:
        out = F.lit(None).cast("string")
        for g, names in GIVEN[script].items():
            out = F.when(gender == g, F.lower(F.element_at(F.array(*map(F.lit, names)), _draw(seed, 0, len(names)) + 1))).otherwise(out)
        return out

    def build(script: str) -> Column:
        return F.array_join(F.transform(parts, lambda w, i: F.when(w.isin(PARTICLES), w).when((i == 0) & (F.size(parts) > 1), given(script)).otherwise(_family(script, seed, i, counter))), " ")

    return _by_script(plain, build)


def _address(plain: Column, seed: Column, counter: Column) -> Column:
    compound = F.regexp_extract(plain, f"(?:{_any(COMPOUNDS)})(?= )", 0)

    def build(script: str) -> Column:
        name = lambda i: _family(script, seed, i, counter)
        return F.array_join(F.transform(F.split(plain, " "), lambda w, i: F.when(w.isin(STREETS + STREET_WORDS), w).when(w.rlike("^[0-9]"), _chars(w, seed)).when((compound != "") & w.endswith(compound), F.concat(name(i), compound)).otherwise(name(i))), " ")

    return _by_script(plain, build)


def surrogate(kind: Column, norm: Column, counter: Column, key: str) -> Column:
    """The surrogate's normal form; of an email only the mailbox is new, its domain is an entity of its own."""
    front, plain = F.substring_index(norm, _SEP, 1), F.substring_index(norm, _SEP, -1)
    seed = F.sha2(F.concat_ws(_SEP, F.lit(key), kind, norm, counter.cast("string")), 256)
    made = _chars(plain, seed)
    octets = F.array_join(F.transform(F.split(plain, r"\."), lambda _, i: (_draw(seed, i, 223) + 1).cast("string")), ".")
    name, domain = F.substring_index(plain, "@", 1), F.substring_index(plain, "@", -1)
    mailbox = F.concat(_chars(name, seed), F.substring(seed, F.lit(1), F.floor(counter / 4).cast("int")), F.lit("@"), domain)
    host = F.concat(_chars(F.substring(plain, F.lit(1), F.length(plain) - F.length(F.substring_index(plain, ".", -1))), seed), F.substring_index(plain, ".", -1))
    draft = F.concat(front, F.substring(made, F.lit(1), F.length(made) - 1))
    check = F.pmod(10 - _luhn(F.concat(draft, F.lit("0"))), F.lit(10)).cast("string")
    card = F.when(_luhn(F.concat(front, plain)) == 0, F.concat(F.substring(made, F.lit(1), F.length(made) - 1), check)).otherwise(made)
    account = F.substring(made, F.lit(3), F.length(made))
    body = (
        F.when(kind == "ip", octets)
        .when(kind == "email", mailbox)
        .when(kind == "domain", host)
        .when(kind == "card", card)
        .when(kind == "iban", F.concat(_iban_check(front, account), account))
        .when(kind == "secret", _chars(plain, seed, plain.rlike("^[0-9a-f]+$|^[0-9A-F]+$")))
        .when(kind == "person", _person(plain, front, seed, counter))
        .when(kind == "address", _address(plain, seed, counter))
        .otherwise(made)
    )
    return F.concat(front, F.lit(_SEP), body)


def _styled(like: Column, word: Column) -> Column:
    """A word with the capitals of another."""
    return F.when((F.length(like) > 1) & (like == F.upper(like)), F.upper(word)).when(F.substring(like, 1, 1) != F.lower(F.substring(like, 1, 1)), F.initcap(word)).otherwise(word)


def _named(body: Column, norm: Column, made: Column) -> Column:
    """Each word of a mention as the surrogate's word in the place that it has in the full name."""
    full, new = F.split(F.substring_index(norm, _SEP, -1), " "), F.split(made, " ")

    def one(w):
        base = F.regexp_replace(w, _POSSESSIVE, "")
        at = F.array_position(full, F.lower(base)).cast("int")
        return F.concat(_styled(base, F.element_at(new, F.when(at > 0, at).otherwise(F.lit(-1)))), F.substring(w, F.length(base) + 1, F.length(w)))

    return F.array_join(F.transform(F.split(body, " "), one), " ")


def _laid_out(kind: Column, e: Column, norm: Column, made: Column, host: Column) -> Column:
    """A surrogate in the layout of a mention: its head, punctuation, blanks and capitals.  host: the surrogate of an email's domain."""
    head, new = _head(kind, e), F.substring_index(made, _SEP, -1)
    body = F.substring(e, F.length(head) + 1, F.length(e))
    upto = lambda i: F.length(F.regexp_replace(F.substring(body, F.lit(1), i + 1), "[^0-9A-Z]", ""))
    filled = F.array_join(F.transform(F.split(body, ""), lambda c, i: F.when(c.rlike("[0-9A-Z]"), F.substring(new, upto(i), F.lit(1))).otherwise(c)), "")
    shouted = (body == F.upper(body)) & (body != F.lower(body))
    email = F.concat(F.substring_index(new, "@", 1), F.lit("@"), F.substring_index(host, _SEP, -1))
    street = F.array_join(F.zip_with(F.split(body, " "), F.split(new, " "), lambda w, n: F.concat(_styled(F.replace(w, F.lit(","), F.lit("")), n), F.when(w.endswith(","), F.lit(",")).otherwise(F.lit("")))), " ")
    return F.concat(
        head,
        F.when(kind == "person", _named(body, norm, new))
        .when(kind == "address", street)
        .when(kind == "email", F.when(shouted, F.upper(email)).otherwise(email))
        .when(kind == "secret", F.concat(new, F.regexp_extract(body, "[\"']$", 0)))
        .when(kind == "ip", new)
        .otherwise(filled),
    )


def _domain(norm: Column) -> Column:
    return F.concat(F.lit(_SEP), F.substring_index(norm, "@", -1))


def _clashing(drawn: DataFrame, taken: list[DataFrame]) -> DataFrame:
    """kind, norm of those in drawn (kind, norm, made) that must draw again."""
    keep = drawn.groupBy("kind", "made").agg(F.min("norm").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    out = drawn.join(keep, ["kind", "made"]).where("norm <> keep").select("kind", "norm")
    for other in taken:
        out = out.unionByName(drawn.join(other, ["kind", "made"], "left_semi").select("kind", "norm"))
    return storage.staged(out.distinct(), "pii-clashes")


def redrawn(entities: DataFrame, key: str, most_rounds: int = 100) -> DataFrame | None:
    """kind, norm, made of the entities (kind, norm; distinct) whose first surrogate clashed, or None if none did."""
    # A made-up mailbox stands at a made-up domain, which is none of the corpus, so it may be a real one's name.
    real = entities.where("kind <> 'email'").select("kind", F.col("norm").alias("made"))
    first = storage.staged(entities.withColumn("made", surrogate(F.col("kind"), F.col("norm"), F.lit(0), key)), "pii-first")
    again, done, counter = _clashing(first, [real]), [], 0
    while not again.isEmpty():
        counter += 1
        if counter > most_rounds:
            raise RuntimeError("a kind of fixed format has fewer surrogates than entities")
        drawn = storage.staged(again.withColumn("made", surrogate(F.col("kind"), F.col("norm"), F.lit(counter), key)), "pii-drawn")
        again = _clashing(drawn, [x.select("kind", "made") for x in (real, first, *done)])
        done.append(storage.staged(drawn.join(again, ["kind", "norm"], "left_anti"), "pii-redrawn"))
    made = None
    for x in done:
        made = x if made is None else made.unionByName(x)
    return made


def overrides(found: DataFrame, key: str) -> DataFrame | None:
    """kind, norm, made of those mentions' entities whose surrogate isn't just the first one of their normal form, or None.  found: kind, norm."""
    local = found.distinct()
    local = storage.staged(local.unionByName(local.where("kind = 'email'").select(F.lit("domain").alias("kind"), _domain(F.col("norm")).alias("norm"))).distinct(), "pii-entities")
    persons = local.where("kind = 'person'").select("norm", F.substring_index("norm", _SEP, 1).alias("g"), F.substring_index("norm", _SEP, -1).alias("name"))
    told = persons.groupBy("name").agg(_gender(F.max(F.col("g") == "f"), F.max(F.col("g") == "m")).alias("g"))
    renamed = persons.drop("g").join(told, "name").select(F.lit("person").alias("kind"), "norm", F.concat("g", F.lit(_SEP), "name").alias("proper"))
    entities = storage.staged(local.where("kind <> 'person'").unionByName(renamed.select("kind", F.col("proper").alias("norm")).distinct()), "pii-proper")
    again = redrawn(entities, key)
    changed = storage.staged(renamed.where("norm <> proper"), "pii-renamed")
    made = surrogate(F.col("kind"), F.col("proper"), F.lit(0), key)
    if again is None:
        return None if changed.isEmpty() else changed.select("kind", "norm", made.alias("made"))
    late = again.select("kind", F.col("norm").alias("proper"), F.col("made").alias("late"))
    return storage.staged(again.select("kind", "norm", "made").unionByName(changed.join(late, ["kind", "proper"], "left").select("kind", "norm", F.coalesce("late", made).alias("made"))), "pii-overrides")


#: Texts with an overridden entity are broadcast up to this number, beyond it joined by shuffle.
FEW_TEXTS = 5_000


def with_surrogates(docs: DataFrame, key: str, count: str | None = None) -> DataFrame:
    """docs with surrogates in ``text`` and, if ``count`` names one, a column with the number of mentions replaced."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"), F.lit(0).alias("__none"))
    rows = docs.select(row.alias("row"), F.col("text").cast("string").alias("text")).withColumn("parts", _split(F.col("text")))
    some = F.size("parts") > 1
    # Each later step reads columns that are written down, so none is worked out twice.
    rows = storage.staged(rows.select("row", F.when(~some | F.col("text").isNull(), F.col("text")).alias("text"), F.when(some, F.col("parts")).alias("parts"), F.monotonically_increasing_id().alias("own")), "pii-rows")
    plain, parted = rows.where("parts IS NULL").select("row", "own", "text"), rows.where("parts IS NOT NULL").select("row", "own", "parts")
    with_persons = _has_person(F.col("parts"))
    named = storage.staged(parted.where(with_persons).withColumn("parts", _with_names(F.col("parts"))), "pii-named")
    parted = parted.where(~with_persons).select("row", "own", "parts", _plain_mentions(F.col("parts")).alias("found")).unionByName(named.select("row", "own", "parts", _resolved_mentions(F.col("parts")).alias("found")))
    mentions = parted.select("own", F.explode("found").alias("x")).select("own", "x.kind", "x.norm")
    other = overrides(mentions.select("kind", "norm"), key)
    drawn = lambda kind, norm: surrogate(kind, norm, F.lit(0), key)
    made = drawn
    if other is not None:
        held = mentions.distinct()
        held = held.unionByName(held.where("kind = 'email'").select("own", F.lit("domain").alias("kind"), _domain(F.col("norm")).alias("norm")).distinct()).join(other, ["kind", "norm"])
        maps = storage.staged(held.groupBy("own").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(_SEP, "kind", "norm"), "made"))).alias("made")), "pii-maps")
        few = maps.limit(FEW_TEXTS + 1).count() <= FEW_TEXTS
        parted = parted.join(F.broadcast(maps) if few else maps, "own", "left")
        made = lambda kind, norm: F.coalesce(F.try_element_at("made", F.concat_ws(_SEP, kind, norm)), drawn(kind, norm))
    # Two steps, as an expression that stands twice is worked out twice.
    new = F.transform("found", lambda x: F.struct(x["e"].alias("e"), x["kind"].alias("kind"), x["norm"].alias("norm"), made(x["kind"], x["norm"]).alias("made"), F.when(x["kind"] == "email", made(F.lit("domain"), _domain(x["norm"]))).alias("host")))
    new = F.transform(new, lambda x: _laid_out(x["kind"], x["e"], x["norm"], x["made"], x["host"]))
    between = F.filter("parts", lambda x, i: i % 2 == 0)
    put = F.array_join(F.flatten(F.zip_with(between, new, lambda a, b: F.array(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))), "")
    done = plain.select("row", "text", F.lit(0).alias("n")).unionByName(parted.select("row", put.alias("text"), F.size("found").alias("n")))
    columns = [_unescaped(F.col("text")).alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns]
    return done.select(*columns, *([F.col("n").alias(count)] if count else []))


#: Session setting with the secret key.
KEY_CONF = "spark.kinfold.pii.key"
#: The key for the synthetic test tables, used with a warning where the session has none; it keeps no secret.
DEMO_KEY = "kinfold demonstration key"


def key_of(spark: SparkSession) -> str:
    key = spark.conf.get(KEY_CONF, None)
    if not key:
        warnings.warn(f"{KEY_CONF} is not set: surrogates are made with the demonstration key, which protects nothing", stacklevel=2)
    return key or DEMO_KEY


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(storage.as_long("doc_id").alias("doc_id"), "text")
    return with_surrogates(docs, key_of(spark), count="n_entities")
