"""Surrogates for personal data, with DataFrame functions only.

Detected entities: e-mail addresses, telephone numbers, payment cards that pass the Luhn
test, IPv4 and IPv6 addresses, social security numbers, IBANs, access keys and assigned secrets, and
persons named after a title or by a known given name. Each distinct entity, in a
normalised form that its spellings share, gets one keyed surrogate of its own type:

* digits stay digits and letters stay letters of the same script and case, punctuation and
  lengths stay; country codes, card issuers and top-level domains are kept, card check
  digits made valid again, and IP octets stay in range;
* a given name has one surrogate in the whole table, whatever titles (one to four) stand before it. Its
  gender is decided once: by the lists, else by the titles it is seen with, else it is open;
* a surname keeps the class of its ending, so that a woman's form stays a woman's form, and
  both forms of one family name ("Иванов", "Иванова") have forms of one surrogate;
* a bare surname or given name elsewhere in a text follows the person named in that text.

Not detected: telephone numbers without country code, parentheses, area code parted as in
212-555-0100, or trunk 0 (bare runs of digits may be anything); IPv6 addresses without a
group of three digits or with an IPv4 tail; persons without a title or known given name;
values without any letter or digit. Spellings of one IPv6 address that differ in more than
case are entities of their own.

A surrogate that is also some original, or that another entity holds, is drawn again with
the next attempt number. From attempt ``WIDEN`` on each draw is a character longer (an IP
address becomes a private IPv6 address), so that drawing ends however full a format is;
distinct entities stay distinct and equal ones stay equal in the whole table.

A null text stays null, an empty one empty; a text without entities is unchanged; texts of
any length are handled whole. Rows may repeat, equal texts change alike and are worked on
once; doc_id is not used. An empty table gives no rows. Input columns may have any names;
one named like the count column is replaced by it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, inner, staged

# Titles by gender, given names by gender, and the parts of surrogate names.
TITLES_MALE = ("Mr", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Signor", "господин", "κύριος")
TITLES_FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Señora", "Sra", "Signora", "госпожа", "κυρία")
TITLES_OTHER = ("Dr", "Prof")
GIVEN_MALE = ("James", "John", "Robert", "Michael", "William", "David", "Richard", "Thomas", "Peter", "Hans", "Klaus", "Stefan", "Pierre", "Jean", "Luc", "Carlos", "Juan", "José", "Ivan", "Иван", "Сергей", "Дмитрий", "Γιώργος", "Νίκος", "Charles", "Joseph", "Daniel", "Matthew", "Anthony", "Andrew", "Paul", "George", "Henry", "Jürgen", "Wolfgang", "Matthias", "Jacques", "François", "Antoine", "Miguel", "Pedro", "Luis", "Giovanni", "Marco", "Александр", "Николай", "Владимир", "Κώστας", "Δημήτρης")
GIVEN_FEMALE = ("Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Susan", "Sarah", "Karen", "Anna", "Maria", "María", "Claudia", "Sabine", "Marie", "Sophie", "Camille", "Carmen", "Lucía", "Olga", "Анна", "Мария", "Ольга", "Ελένη", "Μαρία", "Barbara", "Margaret", "Nancy", "Emily", "Laura", "Helen", "Julia", "Ursula", "Monika", "Petra", "Ingrid", "Isabelle", "Nathalie", "Hélène", "Ana", "Isabel", "Sofía", "Giulia", "Francesca", "Екатерина", "Татьяна", "Наталья", "Елена", "Κατερίνα", "Σοφία")
PARTS = {"latin": ("al", "ber", "cor", "dan", "el", "fin", "gar", "hol", "ir", "jor", "kel", "lan", "mar", "nor", "or", "pel"), "cyrillic": ("ал", "бер", "кор", "дан", "ел", "фин", "гар", "хол", "ир", "жор", "кел", "лан", "мар", "нор", "ор", "пел"), "greek": ("αλ", "βερ", "κορ", "δαν", "ελ", "φιν", "γαρ", "χολ", "ιρ", "ζορ", "κελ", "λαν", "μαρ", "νορ", "ορ", "πελ")}
#: Endings of given names by gender, and of surnames whose form is the same for all.
ENDINGS = {"latin": {"m": "us", "f": "ina", "x": "ey", "surname": "er"}, "cyrillic": {"m": "ий", "f": "ина", "x": "ень", "surname": "енко"}, "greek": {"m": "ος", "f": "ίνα", "x": "ι", "surname": "άκι"}}
#: Surname endings of men and of women; the first that fits counts.
FAMILIES = (("ский", "ская"), ("цкий", "цкая"), ("ов", "ова"), ("ев", "ева"), ("ёв", "ёва"), ("ин", "ина"), ("ын", "ына"), ("ый", "ая"), ("sky", "skaya"), ("ski", "ska"), ("cki", "cka"), ("ov", "ova"), ("ev", "eva"), ("ος", "ου"), ("ης", "η"), ("ας", "α"))
ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåçèéêëìíîïñòóôõöùúûü", "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜ", "абвгдежзиклмнопрстуфхцчшэюя", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ")
#: First and last code points of further letters and digits: Armenian, Hebrew, Arabic and
#: its digits, Devanagari and its digits, Bengali, Tamil, Thai, Georgian, Hangul, Hiragana,
#: Katakana, Han, full-width digits and letters.
RANGES = ((0x0531, 0x0556), (0x0561, 0x0586), (0x05D0, 0x05EA), (0x0627, 0x063A), (0x0641, 0x064A), (0x0660, 0x0669), (0x0905, 0x0939), (0x0966, 0x096F), (0x0995, 0x09A8), (0x0BAE, 0x0BB9), (0x0E01, 0x0E2E), (0x10D0, 0x10F0), (0xAC00, 0xD7A3), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xFF10, 0xFF19), (0xFF21, 0xFF3A), (0xFF41, 0xFF5A))

#: The first attempt number whose draws are longer than the original.
WIDEN = 3

TITLES = TITLES_MALE + TITLES_FEMALE + TITLES_OTHER
#: Titles may follow one another ("Frau Dr.", "Prof. Dr."), and none is a name.
_TITLE = rf"(?:(?:{'|'.join(TITLES)})\.? ){{1,4}}"
_NAME = rf"(?!(?:{'|'.join(TITLES)})(?![\p{{L}}'’-]))\p{{Lu}}[\p{{L}}'’-]+"
_HEX = "[0-9A-Fa-f]{1,4}"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_FIRST = "".join(sorted({n[0] for n in TITLES + GIVEN_MALE + GIVEN_FEMALE}))
_PERSON = rf"(?<![\p{{L}}\p{{N}}_])(?=[{_FIRST}])(?:{_TITLE}{_NAME}(?: {_NAME})?|(?:{'|'.join(GIVEN_MALE + GIVEN_FEMALE)}) {_NAME})"
_ASSIGNED = r"""\b(?:token|password|passwd|secret|api[_-]?key)\s?[=:]\s?["']?"""
_LABEL = r"[\p{L}\p{N}-]{1,63}"
#: In order of precedence.
PATTERNS = {
    "email": rf"(?<![\p{{L}}\p{{N}}._%+-])(?=[._%+-]*[\p{{L}}\p{{N}}])[\p{{L}}\p{{N}}._%+-]{{1,64}}+@{_LABEL}(?:\.{_LABEL}){{0,8}}\.\p{{L}}{{2,24}}",
    "secret": rf"(?i:{_ASSIGNED})(?=[_+/.-]*[A-Za-z0-9])[A-Za-z0-9_+/.-]{{8,}}",
    "key": r"\bAKIA[A-Z0-9]{16}\b",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "ip6": rf"(?<![\p{{L}}\p{{N}}:.])(?=[0-9A-Fa-f:]*[0-9A-Fa-f]{{3}})(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}}|(?:{_HEX}:){{1,7}}:|:(?::{_HEX}){{1,7}})(?![\p{{L}}\p{{N}}:])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9])(?:\+?[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|(?<![0-9])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])|(?<![\p{L}0-9.,+-])[0-9]{3}(?:-[0-9]{3}-|\.[0-9]{3}\.| [0-9]{3} )[0-9]{4}(?![\p{L}0-9-]|[.,][0-9])|(?<![\p{L}0-9.,+-])0[1-9][0-9]{1,3}[ /-][0-9]{5,8}(?![\p{L}0-9-]|[.,][0-9])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "name": _PERSON,
}
ANY = "|".join(PATTERNS.values())
#: What can match in a text for which ``_MARKED`` finds nothing.
_UNMARKED, _MARKED = f"{PATTERNS['secret']}|{_PERSON}", rf"[0-9@]|::|(?:[A-Fa-f]{{1,4}}:){{7}}"


def parted(text: Column, pattern: Column | str) -> Column:
    """What lies between the matches of ``pattern``, and the matches, in turns.

    One pass over the text: it sets each match between two marks, a run of a private-use
    character longer than any that the text holds, ended by another one."""
    one, two = F.lit("\ue000"), F.lit("\ue001")
    mark = F.concat(F.repeat(one, (F.length(text) - F.length(F.replace(text, one, F.lit(""))) + 1).cast("int")), two)
    return F.split(F.regexp_replace(text, F.lit(pattern) if isinstance(pattern, str) else pattern, F.concat(mark, F.lit("$0"), mark)), mark, -1)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column, fixed: bool = False) -> Column:
    """The Luhn sum of a digit string; ``fixed`` counts it as followed by one more digit."""
    shift = 1 if fixed else 0
    places = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when((i + shift) % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, 2 * d.cast("int") - 9).otherwise(2 * d.cast("int"))))
    return F.aggregate(places, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def _kind(value: Column) -> Column:
    out = F.lit("none")
    for kind, pattern in reversed(PATTERNS.items()):
        ok = value.rlike(rf"^(?:{pattern})$")
        out = F.when(ok & (_luhn(_digits(value)) % 10 == 0) if kind == "card" else ok, F.lit(kind)).otherwise(out)
    return out


def _first_of(pairs, default: Column) -> Column:
    """The value beside the first condition that holds."""
    return reduce(lambda out, p: F.when(p[0], p[1]).otherwise(out), reversed(list(pairs)), default)


def _plain(word: Column) -> Column:
    """A word in lower case, Greek accents left out as they move between a name's forms."""
    return F.translate(F.lower(word), "άέήίόύώ", "αεηιουω")


def _family(word: Column) -> Column:
    """(norm, woman): a surname in its man's form, and the ending of a woman's form."""
    plain = _plain(word)
    none = F.struct(plain.alias("norm"), F.lit(None).cast("string").alias("woman"))
    return _first_of(((plain.endswith(f) & (F.length(plain) > len(f) + 1), F.struct(F.concat(F.substring(plain, F.lit(1), F.length(plain) - len(f)), F.lit(m)).alias("norm"), F.lit(f).alias("woman"))) for m, f in FAMILIES), none)


_ENTITY = "array<struct<kind:string,norm:string,within:string,gender:string,woman:string,head:string>>"


def _entity(kind, norm: Column, within: Column | None = None, gender: Column | None = None, woman: Column | None = None, head: Column | None = None) -> Column:
    null = F.lit(None).cast("string")
    rest = ((within, "within"), (gender, "gender"), (woman, "woman"), (head, "head"))
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), norm.alias("norm"), *(F.coalesce(c, null).alias(n) if c is not None else null.alias(n) for c, n in rest))


def _name_parts(value: Column) -> Column:
    """The words of a person's name without its title."""
    title = F.regexp_extract(value, rf"^({_TITLE})", 1)
    telling = F.regexp_extract(title, rf"^(?:(?:{'|'.join(TITLES_OTHER)})\.? )*(\p{{L}}+)", 1)
    by_title = F.when(telling.isin(*TITLES_MALE), "m").when(telling.isin(*TITLES_FEMALE), "f")
    words = F.split(F.substring(value, F.length(title) + 1, F.length(value)), " ")
    given = lambda w: F.lower(w).isin(*[n.lower() for n in GIVEN_MALE + GIVEN_FEMALE])

    def one(w: Column, i: Column) -> Column:
        listed = F.when(F.lower(w).isin(*[n.lower() for n in GIVEN_MALE]), "M").when(F.lower(w).isin(*[n.lower() for n in GIVEN_FEMALE]), "F")
        first = (i < F.size(words) - 1) | ((F.size(words) == 1) & given(w))
        family = _family(w)
        return F.when(first, _entity("given", F.lower(w), gender=F.coalesce(listed, by_title))).otherwise(_entity("surname", family["norm"], woman=family["woman"]))

    return F.transform(words, one)


def _entities(value: Column, kind: Column) -> Column:
    """What of one match needs a surrogate."""
    one = lambda norm, head=None: F.array(_entity(kind, norm, head=head))
    low, digits = F.lower(value), _digits(value)
    domain = F.substring_index(low, "@", -1)
    long_ = F.greatest(F.length(digits) - 10, F.lit(0))
    return (
        F.when(kind == "none", F.array().cast(_ENTITY)).when(kind == "name", _name_parts(value))
        .when(kind == "email", F.array(_entity(kind, F.substring_index(low, "@", 1), domain), _entity("domain", domain)))
        .when(kind == "phone", one(F.substring(digits, long_ + 1, F.length(digits)), F.substring(digits, F.lit(1), long_)))
        .when(kind.isin("card", "ssn"), one(digits)).when(kind == "ip6", one(low))
        .when(kind == "secret", one(F.regexp_replace(value, f"^(?i:{_ASSIGNED})", ""))).when(kind == "iban", one(F.replace(value, F.lit(" "), F.lit(""))))
        .otherwise(one(value))
    ).cast(_ENTITY)


def _draw(key: str, attempt: int) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.col("kind"), F.col("norm"), F.lit(str(attempt))), 256)


def _number(digest: Column, i: Column, below: int) -> Column:
    """A number below ``below`` from place i of a hex digest, which repeats."""
    return F.conv(F.substring(digest, i * 4 % 60 + 1, 4), 16, 10).cast("int") % below


def _redrawn(text: Column, digest: Column) -> Column:
    """Every letter and digit by another of its alphabet."""

    def one(ch: Column, i: Column) -> Column:
        # places beyond the digest's 15 use it again, turned by their distance
        place = _number(digest, i, 65536) + i * 7919
        of = lambda alphabet: F.substring(F.lit(alphabet), (place % len(alphabet) + 1).cast("int"), F.lit(1))
        code = F.ascii(ch)
        known = [(F.instr(F.lit(a), ch) > 0, of(a)) for a in ALPHABETS]
        known += [((code >= a) & (code <= b), F.decode(F.unhex(F.lpad(F.hex(place % (b - a + 1) + a), 4, "0")), "UTF-16BE")) for a, b in RANGES]
        return F.when(ch == "", ch).otherwise(_first_of([*known, (ch.rlike(r"[\p{L}\p{N}]"), of(ALPHABETS[1]))], ch))

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _script(text: Column) -> Column:
    return F.when(text.rlike(r"\p{IsCyrillic}"), "cyrillic").when(text.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _person(kind: Column, norm: Column, gender: Column, digest: Column, attempt: int) -> Column:
    """A name in lower case, of two parts and an ending; each attempt past the first adds a part."""

    def of(script: str) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.lit(2 + attempt)), lambda i: F.element_at(F.array(*[F.lit(p) for p in PARTS[script]]), _number(digest, i, len(PARTS[script])) + 1))
        last = F.when(kind == "surname", _first_of(((norm.endswith(m), F.lit(m)) for m, _ in FAMILIES), F.lit(ENDINGS[script]["surname"]))).otherwise(_first_of(((gender == g, F.lit(ENDINGS[script][g])) for g in "mf"), F.lit(ENDINGS[script]["x"])))
        return F.concat(F.array_join(parts, ""), last)

    script = _script(norm)
    return F.when(script == "cyrillic", of("cyrillic")).when(script == "greek", of("greek")).otherwise(of("latin"))


def _surrogate(attempt: int) -> Column:
    """From the columns kind, norm, gender, digest and fresh, the norm redrawn."""
    kind, norm, digest, fresh = (F.col(c) for c in ("kind", "norm", "digest", "fresh"))
    more = F.substring(F.sha2(F.concat(digest, F.lit("wider")), 256), 1, max(0, attempt - WIDEN + 1))
    digits, letters = F.translate(more, "abcdef", "012345"), F.translate(more, "0123456789", "ghijklmnop")
    body = F.concat(F.substring(norm, 1, 1), F.substring(fresh, F.lit(2), F.length(norm) - 2), digits)
    card = F.concat(body, ((10 - _luhn(body, True) % 10) % 10).cast("string"))
    octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_number(digest, i, 254) + 1).cast("string")), ".")
    # an address has at most 39 places, the digest 64
    hexes = F.array_join(F.transform(F.split(norm, ""), lambda ch, i: F.when(ch.isin(":", ""), ch).otherwise(F.substring(digest, i + 1, F.lit(1)))), "")
    if attempt >= WIDEN:
        octets = hexes = F.concat(F.lit("fd"), F.substring(digest, 1, 2), *(F.concat(F.lit(":"), F.substring(digest, 4 * i + 1, 4)) for i in range(1, 8)))
    last = F.substring_index(norm, ".", -1)
    domain = F.concat(F.substring(fresh, F.lit(1), F.length(norm) - F.length(last) - 1), letters, F.lit("."), last)
    phone = F.concat((_number(digest, F.lit(14), 8) + 2).cast("string"), F.substring(fresh, F.lit(2), F.lit(64)), digits)
    return (
        F.when(kind == "card", card).when(kind == "ip", octets).when(kind == "ip6", hexes).when(kind == "domain", domain).when(kind == "phone", phone)
        .when(kind == "key", F.concat(F.lit("AKIA"), F.substring(fresh, F.lit(5), F.lit(16)), F.upper(letters)))
        .when(kind == "iban", F.concat(F.substring(norm, 1, 2), F.substring(fresh, F.lit(3), F.lit(40)), digits))
        .when(kind == "ssn", F.concat(fresh, digits))
        .when((kind == "secret") & norm.rlike("^[0-9a-f]+$"), F.concat(F.substring(F.concat(digest, F.sha2(digest, 256), F.repeat(digest, F.ceil(F.length(norm) / 64).cast("int"))), F.lit(1), F.length(norm)), more))
        .when(kind.isin("surname", "given"), _person(kind, norm, F.col("gender"), digest, attempt))
        .otherwise(F.concat(fresh, letters))
    )


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(kind, norm, within, surrogate) for distinct entities, each surrogate unlike any
    original and any other surrogate of its kind (for an e-mail's local part: within its
    domain). The colliding rows are few after each round."""
    place = F.coalesce("within", F.lit("")).alias("within")
    listed, titled = F.max(F.when(F.col("gender").isin("M", "F"), F.lower("gender"))), F.collect_set(F.when(F.col("gender").isin("m", "f"), F.col("gender")))
    known = entities.groupBy("kind", "norm", place).agg(listed.alias("listed"), titled.alias("titled"))
    open_rows = cut(known.select("kind", "norm", "within", F.coalesce("listed", F.when(F.size("titled") == 1, F.col("titled")[0]), F.lit("x")).alias("gender")))
    # an e-mail's local part may recur: its domain is no original
    held = open_rows.where("kind <> 'email'").select("kind", "within", F.col("norm").alias("surrogate"), F.lit(0).alias("order"), F.lit("").alias("norm"))
    settled, attempt = None, 0
    while True:
        fresh = open_rows.withColumn("digest", _draw(key, attempt)).withColumn("fresh", _redrawn(F.col("norm"), F.col("digest")))
        drawn = cut(fresh.withColumn("surrogate", _surrogate(attempt)).drop("digest", "fresh"))
        claims = held.unionByName(drawn.select("kind", "within", "surrogate", F.lit(1).alias("order"), "norm"))
        owners = claims.groupBy("kind", "within", "surrogate").agg(F.min(F.struct("order", "norm")).alias("o")).where("o.order = 1").select("kind", "within", "o.norm")
        kept = cut(drawn.join(owners, ["kind", "within", "norm"], "left_semi"))
        settled = kept if settled is None else settled.union(kept)
        open_rows = cut(drawn.drop("surrogate").join(kept, ["kind", "within", "norm"], "left_anti"))
        if not open_rows.take(1):
            return settled.select("kind", "norm", "within", "surrogate")
        held = held.unionByName(kept.select("kind", "within", "surrogate", F.lit(0).alias("order"), "norm"))
        attempt += 1


def _filled(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced in turn, and the digits that remain."""
    start = F.struct(F.lit(1).alias("i"), F.lit("").alias("out"))

    def step(s: Column, ch: Column) -> Column:
        digit = ch.rlike("^[0-9]$")
        return F.struct(F.when(digit, s["i"] + 1).otherwise(s["i"]).alias("i"), F.concat(s["out"], F.when(digit, F.substring(digits, s["i"], F.lit(1))).otherwise(ch)).alias("out"))

    return F.aggregate(F.split(value, ""), start, step, lambda s: F.concat(s["out"], F.substring(digits, s["i"], F.length(digits))))


def _spaced(value: Column, text: Column) -> Column:
    """``text`` with the spaces of ``value`` put back."""
    start = F.struct(F.lit(1).alias("i"), F.lit("").alias("out"))

    def step(s: Column, ch: Column) -> Column:
        return F.struct(F.when(ch == " ", s["i"]).otherwise(s["i"] + 1).alias("i"), F.concat(s["out"], F.when(ch == " ", ch).otherwise(F.substring(text, s["i"], F.lit(1)))).alias("out"))

    return F.aggregate(F.split(value, ""), start, step, lambda s: F.concat(s["out"], F.substring(text, s["i"], F.length(text))))


def _worded(was: Column, part: Column) -> Column:
    """A name's surrogate in the form and case of the word ``was``."""
    man = part["surrogate"]
    woman = _first_of(((part["woman"] == f, F.concat(F.substring(man, F.lit(1), F.length(man) - len(m)), F.lit(f))) for m, f in FAMILIES), man)
    word = F.when((part["kind"] == "surname") & part["woman"].isNotNull(), woman).otherwise(man)
    return F.when((F.upper(was) == was) & (F.length(was) > 1), F.upper(word)).otherwise(F.initcap(word))


def _bare(value: Column) -> Column:
    return F.split(F.regexp_replace(value, rf"^{_TITLE}", ""), " ")


def _rendered() -> Column:
    """A match in its own format; ``parts`` are its entities in order, with surrogates."""
    value, kind, parts = F.col("value"), F.col("match"), F.col("parts")
    first, last = parts[0]["surrogate"], F.element_at("parts", -1)["surrogate"]
    email = F.concat(first, F.lit("@"), last)
    title = F.regexp_extract(value, rf"^({_TITLE})", 1)
    upper = F.upper(value) == value
    return (
        F.when(kind == "email", F.when(upper, F.upper(email)).otherwise(email))
        .when(kind == "phone", _filled(value, F.concat(parts[0]["head"], first))).when(kind.isin("card", "ssn"), _filled(value, first))
        .when(kind == "secret", F.concat(F.regexp_extract(value, f"^((?i:{_ASSIGNED}))", 1), first))
        .when(kind == "iban", _spaced(value, first)).when(kind == "ip6", F.when(upper, F.upper(first)).otherwise(first))
        .when(kind == "name", F.concat(title, F.array_join(F.zip_with(_bare(value), parts, _worded), " ")))
        .otherwise(first)
    )


def replacements(texts: DataFrame, key: str) -> DataFrame:
    """(tid, text, n) of texts given as (tid, pieces), pieces as of ``parted``."""
    places = texts.select("tid", F.posexplode("pieces").alias("at", "value"))
    matches = places.where("at % 2 = 1")
    values = cut(matches.select("value").distinct().withColumn("match", _kind(F.col("value"))).where("match <> 'none'"))
    parts = cut(values.select("value", "match", F.posexplode(_entities(F.col("value"), F.col("match"))).alias("i", "e")).select("value", "match", "i", "e.*"))
    known = assign(parts, key)
    joined = parts.withColumn("within", F.coalesce("within", F.lit(""))).join(known, ["kind", "norm", "within"])
    rendered = joined.groupBy("value", "match").agg(F.sort_array(F.collect_list(F.struct("i", "kind", "surrogate", "woman", "head"))).alias("parts"))
    names = F.when(F.col("match") == "name", F.zip_with(_bare(F.col("value")), F.col("parts"), lambda w, p: F.struct(w.alias("was"), _worded(w, p).alias("now"))))
    rendered = cut(rendered.select("value", _rendered().alias("now"), names.alias("names")))

    found = matches.join(rendered, "value", "left")
    swapped = found.groupBy("tid").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", F.coalesce("now", "value").alias("now")))), lambda x: x["now"]).alias("hits"), F.count("now").alias("n"))
    # the words of a text that follow the persons named in it
    named = cut(found.where("names is not null").select("tid", F.explode("names").alias("x")).select("tid", "x.*").groupBy("tid", "was").agg(F.min("now").alias("now")))
    gaps = places.where("at % 2 = 0").join(named.select("tid").distinct(), "tid", "left_semi")
    words = gaps.select("tid", "at", F.posexplode(parted(F.col("value"), r"(?<!\p{L})\p{Lu}[\p{L}'’-]*\p{L}")).alias("i", "was")).join(named, ["tid", "was"], "left")
    told = words.groupBy("tid", "at").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", F.coalesce("now", "was").alias("now")))), lambda x: x["now"]), "").alias("gap"))
    told = told.groupBy("tid").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "gap"))), lambda x: x["gap"]).alias("gaps"))

    kept = F.coalesce("gaps", F.filter("pieces", lambda p, i: i % 2 == 0))
    text = F.array_join(F.zip_with(kept, F.concat("hits", F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    return texts.join(swapped, "tid").join(told, "tid", "left").select("tid", text.alias("text"), "n")


def replace(docs: DataFrame, key: str = "corpus", text_column: str = "text", count_column: str | None = "n_entities") -> DataFrame:
    """The columns of ``docs`` with surrogates in ``text_column``, and ``count_column``.

    Every text is searched once; what was found is written beside the rows, and only texts
    with matches take part in what follows.
    """
    if count_column:
        docs = docs.drop(count_column)
    rows, column = inner(docs)
    text = F.col(column[text_column]).cast("string")
    pieces = F.when(text.rlike(_MARKED), parted(text, ANY)).otherwise(parted(text, _UNMARKED))
    parts = rows.withColumn("pieces", pieces).withColumn("hit", F.coalesce(F.size("pieces") > 1, F.lit(False)))
    parts = parts.withColumns({"tid": F.when(F.col("hit"), F.sha2(text, 256)), "pieces": F.when(F.col("hit"), F.col("pieces")), column[text_column]: F.when(~F.col("hit"), text)})
    held = staged(parts.drop("hit"), "surrogates")
    clean, dirty = held.where("tid is null"), held.where("tid is not null")
    new = replacements(cut(dirty.groupBy("tid").agg(F.first("pieces").alias("pieces"))), key)
    changed = dirty.drop("pieces", column[text_column]).join(new.withColumnRenamed("text", column[text_column]), "tid")
    order = [F.col(c) for c in rows.columns]
    out = clean.select(*order, F.lit(0).cast("long").alias("n")).union(changed.select(*order, "n"))
    return out.toDF(*docs.columns, count_column) if count_column else out.drop("n").toDF(*docs.columns)
