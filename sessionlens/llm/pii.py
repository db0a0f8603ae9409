"""Surrogates for personal data and secrets, by DataFrame functions only.

Entities are found by one alternation of patterns and replaced in place.  A
surrogate is a function of a secret key, the entity's type and its normal form,
so that the same entity gets the same surrogate in every document and spelling
(coreference), and it keeps what makes the entity plausible:

- e-mail: letters for letters, digits for digits, local part and domain apart, so
  that addresses of one domain keep sharing one; the top domain stays.
- phone, card, social security number: the punctuation stays and digits are
  dealt anew; a phone keeps its country code (a number with +1 and one without
  any are the same phone), a card its first digit and a valid
  check digit, a social security number begins with 9, which is never issued.
- IP address: four new octets.  IBAN: the country stays, and the check digits are valid.
- access key and secret: same length and kinds of characters.
- name after a form of address: first name in the script of the name, of the gender
  that this person's forms tell most often in the corpus; first and last name are
  mapped apart, so that "Mrs. Ada Holt", "Dr. Ada Holt" and "Mrs. Holt" stay one person.
  Where a text names a person so, the name is also replaced where it stands alone in
  that text, whole or the family name, spelled as there.

Distinctness: over all documents, no two different entities of one type may get
the same surrogate, and no surrogate may equal an entity that occurs.  A name has
two parts that are kept distinct each for itself: the family name among all, the
given name among those of its family.  Parts that break this get a further
attempt (a number that enters the hash) until none does, and names and mailboxes
grow with the attempts, so their space is never full.  The parts with more than
the first attempt are joined to the documents.  If clashes are left after
MOST_ROUNDS rounds, that is an error.

Null texts stay null, empty texts and those without entities stay as they are;
texts of any length are searched whole; equal texts are treated alike, and
repeated rows give a row each.  Other columns pass through whatever their names
(but see `pseudonymise` for two).  No rows give no rows.
"""

import itertools
import logging
import secrets
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import checkpointed, spare

log = logging.getLogger(__name__)
MOST_ROUNDS = 200
TYPES = ("email", "ip", "phone", "card", "ssn", "iban", "access_key", "name", "secret")

# Forms of address by gender and script, and given names and syllables of family names by script.
FORMS_M = ("Mr", "Herr", "Monsieur", "Señor", "Sir", "господин", "κύριος")
FORMS_F = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "госпожа", "κυρία")
FORMS_N = ("Dr", "Prof")
GIVEN = {
    "latin": {
        "m": "Adam Bruno Carl David Emil Felix Georg Henri Ivan Jonas Karl Louis Marco Noel Oscar Paul".split(),
        "f": "Anna Berta Clara Diana Elena Flora Greta Helen Irene Julia Karin Laura Maria Nora Olga Paula".split(),
        "n": "Alex Chris Dana Jules Kim Leslie Lou Nicky Pat Robin Sam Sascha Sidney Taylor Toni Val".split(),
    },
    "cyrillic": {
        "m": "Антон Борис Виктор Глеб Денис Егор Иван Кирилл".split(),
        "f": "Анна Вера Галина Дарья Елена Ирина Нина Ольга".split(),
        "n": "Женя Саша Валя Шура Паша Слава Тоня Миша".split(),
    },
    "greek": {
        "m": "Αλέξης Γιάννης Δημήτρης Κώστας Μάνος Νίκος Πέτρος Στέλιος".split(),
        "f": "Άννα Βασιλική Ελένη Ζωή Ιωάννα Μαρία Νίκη Σοφία".split(),
        "n": "Φώτης Χάρης Άγγελος Λευτέρης Πάρις Θέμης Ερμής Ηλίας".split(),
    },
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha he ka ke la le lo ma me mo na ne ra re ro sa se ta te to va ve".split(),
    "cyrillic": "ба бе бо ва ве да де до за ка ко ла ле ло ма мо на не но ра ро са се та те то".split(),
    "greek": "βα βε γα γο δα δε κα κο λα λε λο μα με μο να νε ρα ρο σα σε τα τε το".split(),
}

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_FORM = r"\b(?:" + "|".join(FORMS_M + FORMS_F + FORMS_N) + r")\.?[  ]"
_WORD = r"\p{Lu}(?:\p{L}|['-](?!s(?!\p{L}))(?=\p{L}))+"  # without a possessive ending
PATTERNS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)",
    "phone": r"(?<![\d.])\d{3}\.\d{3}\.\d{4}(?!\.?\d)|\+\d{1,3}[ -]?\(\d{2,4}\)[ -]?\d{3}[ -]?\d{4}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])|\+\d{1,3}(?:[ -]\d{2,4}){2,4}(?!\d)",
    "card": r"(?<!\d)(?:\d{4}[ -]?){3}\d{4}(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "access_key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "name": _FORM + _WORD + r"(?:[ \u00A0]" + _WORD + ")?",
    "secret": r"(?<=(?:password|passwd|token|secret|api_key|apikey)[ ]{0,2}[=:][ ]{0,2}[\"']?)[A-Za-z0-9+/_-]{8,}",
}
_ORDER = ("email", "access_key", "iban", "ip", "phone", "card", "ssn", "secret", "name")
ANY = "|".join(f"(?:{PATTERNS[t]})" for t in _ORDER)
#: Every entity's text holds a digit, "@" or one of these words; a text without any needs no further look.
WORDS = (*FORMS_M, *FORMS_F, *FORMS_N, "AKIA", "ASIA", "password", "passwd", "token", "secret", "api_key", "apikey")


def may_hold(text: Column) -> Column:
    """Plain searches, far cheaper than the patterns."""
    starts = [w for w in WORDS if not any(w != v and w.startswith(v) for v in WORDS)]  # "Mr" is in "Mrs"
    return reduce(Column.__or__, (text.contains(w) for w in starts), text.rlike("[0-9@]"))


_KEYS: dict[str, str] = {}


def surrogate_key(spark: SparkSession) -> str:
    """The secret that the session names in `spark.sessionlens.surrogateKey`.

    If it names none, one is drawn for this application: nobody can guess it, and surrogates
    of other runs are others.
    """
    if key := spark.conf.get("spark.sessionlens.surrogateKey", None):
        return key
    app = spark.sparkContext.applicationId
    if app not in _KEYS:
        log.warning("spark.sessionlens.surrogateKey isn't set: surrogates hold for this run only")
        _KEYS[app] = secrets.token_hex(16)
    return _KEYS[app]


def entity_type(e: Column) -> Column:
    """Type of an entity that ANY has found; a match of none but the last is a secret."""
    out = F.when(e.rlike(f"^(?:{PATTERNS['email']})$"), "email")
    for t in _ORDER[1:]:
        if t != "secret":
            out = out.when(e.rlike(f"^(?:{PATTERNS[t]})$"), t)
    return out.otherwise("secret")


def normal_form(e: Column, kind: Column) -> Column:
    """The same for every spelling of an entity."""
    digits = F.regexp_replace(e, "[^0-9]", "")
    name = F.regexp_replace(F.lower(F.regexp_replace(e, _FORM, "")), "[ \\u00A0]+", " ")
    return (
        F.when((kind == "phone") & e.rlike(r"^\+1[^0-9]"), F.substring(digits, F.lit(2), F.length(digits)))
        .when(kind.isin("phone", "card", "ssn"), digits)
        .when(kind == "email", F.lower(e))
        .when(kind == "iban", F.regexp_replace(e, " ", ""))
        .when(kind == "name", name)
        .otherwise(e)
    )


def gender_of(e: Column) -> Column:
    """The gender that a name's form of address tells: m, f, or n."""
    return F.when(e.rlike("^(?:" + "|".join(FORMS_M) + r")\.?[ \u00A0]"), "m").when(e.rlike("^(?:" + "|".join(FORMS_F) + r")\.?[ \u00A0]"), "f").otherwise("n")


def _let(value: Column, body) -> Column:
    """body(value), the value computed once and the expression not repeated."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _seed(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *parts), 256)


def _pick(seed: Column, at: Column, n: int | Column) -> Column:
    """A number from 0 to n - 1 for place `at` of a stream."""
    return F.pmod(F.xxhash64(seed, at), n if isinstance(n, Column) else F.lit(n)).cast("int")


def _chars(e: Column) -> Column:
    return F.split(e, "(?!^)(?!$)")


def _spell(e: Column, seed: Column, one) -> Column:
    """e with every character c at place i replaced by one(seed, c, i)."""
    return F.array_join(F.transform(_chars(e), lambda c, i: one(seed, c, i)), "")


def _letter_of(alphabet: str, seed: Column, i: Column) -> Column:
    return F.substring(F.lit(alphabet), _pick(seed, i, len(alphabet)) + 1, F.lit(1))


_DIGITS, _UPPER, _LOWER, _HEX = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"


def _same_class(seed: Column, c: Column, i: Column) -> Column:
    return F.when(c.between("0", "9"), _letter_of(_DIGITS, seed, i)).when(c.between("A", "Z"), _letter_of(_UPPER, seed, i)).when(c.between("a", "z"), _letter_of(_LOWER, seed, i)).otherwise(c)


def _lower_class(seed: Column, c: Column, i: Column) -> Column:
    """As _same_class, the stream the same for both cases."""
    low = F.substring(F.lit(_LOWER), _pick(seed, i, 26) + 1, F.lit(1))
    return F.when(c.between("0", "9"), _letter_of(_DIGITS, seed, i)).when(c.between("A", "Z"), F.upper(low)).when(c.between("a", "z"), low).otherwise(c)


def _digit_places(e: Column, digits: Column) -> Column:
    """The digits of e replaced one by one by those of `digits`."""
    place = lambda i: F.length(F.regexp_replace(F.substring(e, F.lit(1), i + 1), "[^0-9]", ""))
    return F.array_join(F.transform(_chars(e), lambda c, i: F.when(c.between("0", "9"), F.substring(digits, place(i), F.lit(1))).otherwise(c)), "")


def _random_digits(seed: Column, n: Column, first: str = _DIGITS) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.when(i == 0, _letter_of(first, seed, i)).otherwise(_letter_of(_DIGITS, seed, i))), "")


def _luhn_digit(digits: Column) -> Column:
    """The check digit that follows these digits."""
    d = F.transform(F.reverse(_chars(digits)), lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2).otherwise(c.cast("int")))
    total = F.aggregate(d, F.lit(0), lambda acc, x: acc + F.when(x > 9, x - 9).otherwise(x))
    return F.pmod(F.lit(10) - total % 10, F.lit(10)).cast("string")


def _script(e: Column) -> Column:
    return F.when(e.rlike(r"\p{IsCyrillic}"), "cyrillic").when(e.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _words(seed: Column, words: Column, n: Column, between: str) -> Column:
    """n words picked from a list, put together."""
    return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(words, _pick(seed, i, F.size(words)) + 1)), between)


def family_surrogate(family: Column, attempt: Column, key: str) -> Column:
    """Three syllables, and one more every four attempts."""
    script = _script(family)
    lists = F.when(script == "cyrillic", " ".join(SYLLABLES["cyrillic"])).when(script == "greek", " ".join(SYLLABLES["greek"])).otherwise(" ".join(SYLLABLES["latin"]))
    known = F.struct(_seed(key, F.lit("family"), family, attempt.cast("string")).alias("seed"), F.split(lists, " ").alias("words"), (F.floor(attempt / 4).cast("int") + 3).alias("n"))
    return _let(known, lambda x: F.initcap(_words(x["seed"], x["words"], x["n"], "")))


def given_surrogate(norm: Column, gender: Column, attempt: Column, key: str) -> Column:
    """Of a name in normal form, given and family: one name, and one more every eight attempts."""
    kind = F.concat(_script(norm), F.lit(":"), gender)
    lists = reduce(lambda out, k: out.when(kind == f"{k[0]}:{k[1]}", " ".join(GIVEN[k[0]][k[1]])), ((s, g) for s in GIVEN for g in GIVEN[s]), F.when(F.lit(False), ""))
    known = F.struct(_seed(key, F.lit("given"), F.substring_index(norm, " ", 1), attempt.cast("string")).alias("seed"), F.split(lists, " ").alias("words"), (F.floor(attempt / 8).cast("int") + 1).alias("n"))
    return _let(known, lambda x: _words(x["seed"], x["words"], x["n"], "-"))


def family_of(norm: Column) -> Column:
    return F.element_at(F.split(norm, " "), -1)


def _name(e: Column, norm: Column, key: str, attempt: Column, gender: Column, given_attempt: Column) -> Column:
    last = family_surrogate(family_of(norm), attempt, key)
    whole = F.when(norm.contains(" "), F.concat(given_surrogate(norm, gender, given_attempt, key), F.lit(" "), last)).otherwise(last)
    return F.concat(F.regexp_extract(e, "^" + _FORM, 0), whole)


def _iban(e: Column, seed: Column) -> Column:
    """Country, valid check digits, the rest dealt anew; spaces stay."""
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    place = lambda i: F.length(F.replace(F.substring(e, F.lit(1), i + 1), F.lit(" "), F.lit("")))

    def checked(x: Column) -> Column:
        rest = F.aggregate(_chars(F.concat(x["body"], x["country"], F.lit("00"))), F.lit(0), lambda r, c: (r * F.when(c.between("0", "9"), 10).otherwise(100) + value(c)) % 97)
        return F.concat(x["country"], F.lpad((98 - rest).cast("string"), 2, "0"), x["body"])

    plain = F.replace(e, F.lit(" "), F.lit(""))
    parts = F.struct(F.substring(plain, 1, 2).alias("country"), _spell(F.substring(plain, F.lit(5), F.length(plain)), seed, _same_class).alias("body"))
    return _let(_let(parts, checked), lambda new: F.array_join(F.transform(_chars(e), lambda c, i: F.when(c == " ", c).otherwise(F.substring(new, place(i), F.lit(1)))), ""))


def surrogate(e: Column, kind: Column, norm: Column, attempt: Column, gender: Column, given_attempt: Column, key: str) -> Column:
    """What stands in for entity e; of a name `attempt` is that of the family, and gender and given_attempt count too."""
    known = F.struct(e.alias("e"), kind.alias("kind"), norm.alias("norm"), attempt.alias("attempt"), gender.alias("gender"), given_attempt.alias("given"))
    seeds = lambda x: F.struct(*(x[c].alias(c) for c in ("e", "kind", "norm", "attempt", "gender", "given")), _seed(key, x["kind"], x["norm"], x["attempt"].cast("string")).alias("seed"))
    return _let(known, lambda x: _let(seeds(x), lambda y: _surrogate(y, key)))


def _surrogate(x: Column, key: str) -> Column:
    e, kind, norm, attempt, seed = (x[c] for c in ("e", "kind", "norm", "attempt", "seed"))
    size = F.length(norm)
    domain = F.substring_index(e, "@", -1)
    halves = F.struct(F.regexp_extract(domain, r"^(.*)(\.[^.]+)$", 1).alias("name"), F.regexp_extract(domain, r"^(.*)(\.[^.]+)$", 2).alias("top"), _seed(key, F.lit("domain"), F.lower(domain)).alias("seed"))
    host = _let(halves, lambda h: F.concat(_spell(h["name"], h["seed"], _lower_class), h["top"]))
    # one letter more every six attempts, for domains with nearly all mailboxes of a length
    longer = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(attempt / 6).cast("int")), lambda i: F.when(i > 0, _letter_of(_LOWER, seed, -i)).otherwise("")), "")
    email = F.concat(_spell(F.substring_index(e, "@", 1), seed, _lower_class), longer, F.lit("@"), host)
    octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_pick(seed, i, 254) + 1).cast("string")), ".")
    code = F.when(e.startswith("+"), F.regexp_extract(e, r"^\+(\d{1,3})[ (-]", 1)).otherwise("")
    phone = _let(code, lambda c: F.concat(c, _random_digits(seed, size - F.when(c == "1", 0).otherwise(F.length(c)), "23456789")))
    card = _let(F.concat(F.substring(norm, 1, 1), _random_digits(seed, size - 2)), lambda body: F.concat(body, _luhn_digit(body)))
    ssn = F.concat(F.lit("9"), _random_digits(seed, size - 1))
    digits = F.when(kind == "phone", phone).when(kind == "card", card).otherwise(ssn)
    access = F.concat(F.substring(e, 1, 4), _spell(F.substring(e, F.lit(5), F.length(e)), seed, _same_class))
    hexes = _spell(e, seed, lambda s, c, i: _letter_of(_HEX, s, i))
    return (
        F.when(kind == "email", email)
        .when(kind == "ip", octets)
        .when(kind.isin("phone", "card", "ssn"), _let(digits, lambda d: _digit_places(e, d)))
        .when(kind == "iban", _iban(e, seed))
        .when(kind == "access_key", access)
        .when(kind == "name", _name(e, norm, key, attempt, x["gender"], x["given"]))
        .when(e.rlike("^[0-9a-f]+$"), hexes)
        .otherwise(_spell(e, seed, _same_class))
    )


def _entities(text: Column) -> Column:
    """The entities of the text in order: e, kind, norm."""
    none = F.array().cast("array<string>")
    found = F.when(may_hold(text), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(none)
    kinds = F.transform(found, lambda e: F.struct(e.alias("e"), entity_type(e).alias("kind")))
    return F.transform(kinds, lambda x: F.struct(x["e"].alias("e"), x["kind"].alias("kind"), normal_form(x["e"], x["kind"]).alias("norm")))


def _parts(kind: Column, norm: Column) -> Column:
    """What of an entity has an attempt of its own: part (its kind) and norm."""
    one = lambda k, n: F.struct(k.alias("part"), n.alias("norm"))
    family, given = one(F.lit("family"), family_of(norm)), one(F.lit("given"), norm)
    return F.when(kind != "name", F.array(one(kind, norm))).when(norm.contains(" "), F.array(family, given)).otherwise(F.array(family))


def entity_attempts(docs: DataFrame, text: str, key: str) -> DataFrame:
    """part, norm, attempt, gender of the parts of entities that need more than the first attempt to keep surrogates distinct, or whose forms of address differ."""
    hit = docs.select(F.explode(_entities(F.col(text))).alias("x")).select("x.*").withColumn("g", F.when(F.col("kind") == "name", gender_of(F.col("e"))).otherwise("n"))
    of = lambda g: F.count_if(F.col("g") == g)
    gender = F.when((of("f") > 0) & (of("f") >= of("m")), "f").when(of("m") > 0, "m").otherwise("n")
    real = hit.groupBy("kind", "norm").agg(F.min("e").alias("e"), gender.alias("gender"), (F.min("g") != F.max("g")).alias("mixed"))  # by what an entity is, before its parts: few rows are left
    real = real.select("e", "gender", "mixed", F.explode(_parts(F.col("kind"), F.col("norm"))).alias("x")).groupBy("x.part", "x.norm").agg(F.min("e").alias("e"), F.max("gender").alias("gender"), F.max("mixed").alias("mixed"))
    real = checkpointed(real.withColumn("attempt", F.lit(0)))
    known = real.select("part", F.col("norm").alias("made"), F.lit(True).alias("taken"))
    part, norm, attempt = F.col("part"), F.col("norm"), F.col("attempt")
    made = _let(surrogate(F.col("e"), part, norm, attempt, F.lit("n"), F.lit(0), key), lambda x: normal_form(x, part))
    made = F.when(part == "family", F.lower(family_surrogate(norm, attempt, key))).when(part == "given", F.concat_ws(" ", F.lower(given_surrogate(norm, F.col("gender"), attempt, key)), family_of(norm))).otherwise(made)
    for done in itertools.count():
        now = real.withColumn("made", made)
        first = now.groupBy("part", "made").agg(F.min("norm").alias("first"), F.count(F.lit(1)).alias("n"))
        bad = first.join(known, ["part", "made"], "left").where((F.col("n") > 1) | F.col("taken"))
        if not bad.head(1):
            break
        if done >= MOST_ROUNDS:
            kinds = sorted(r[0] for r in bad.select("part").distinct().collect())
            raise ValueError(f"no room for distinct surrogates of {', '.join(kinds)} after {done} rounds")
        clash = now.join(bad, ["part", "made"], "left").withColumn("again", F.coalesce(F.col("taken") | (F.col("norm") != F.col("first")), F.lit(False)))
        real = checkpointed(clash.select("part", "norm", "e", "gender", "mixed", (F.col("attempt") + F.col("again").cast("int")).alias("attempt")))
    return real.where("attempt > 0 or (mixed and part = 'given')").select("part", "norm", "attempt", "gender")


def _bare(text: Column, names: Column) -> Column:
    """text with names (old, new: without form of address) replaced where they stand alone: whole first, then the family name."""

    def replaced(t: Column, x: Column, of) -> Column:
        word = F.regexp_replace(of(x["old"]), "[ \u00A0]", "\\\\E[ \u00A0]\\\\Q")
        return F.regexp_replace(t, F.concat(F.lit(r"(?U)(?<![\p{L}\p{N}'-])\Q"), word, F.lit(r"\E(?![\p{L}\p{N}]|-\p{L}|'(?!s(?!\p{L}))\p{L})")), of(x["new"]))

    last = lambda c: F.regexp_extract(c, "[^ \u00A0]+$", 0)
    whole = F.aggregate(F.filter(names, lambda x: x["old"].rlike("[ \u00A0]")), text, lambda t, x: replaced(t, x, lambda c: c))
    return F.aggregate(names, whole, lambda t, x: replaced(t, x, last))


def pseudonymise(docs: DataFrame, key: str, text: str = "text", report: bool = True) -> DataFrame:
    """docs with surrogates in `text`, under a secret key.

    With `report`, also n_entities and entity_types (count of each type found, in
    order of TYPES; names that stand alone don't count); columns of these names are replaced.
    """
    more = entity_attempts(docs, text, key)
    found, name, at = (spare(c, docs.columns) for c in ("ents", "text_hash", "attempts"))
    ents = docs.withColumn(found, _entities(F.col(text)))
    known = lambda part, norm: F.lit(None).cast("struct<attempt:int,gender:string>")
    if more.head(1):
        # the attempts of an entity are the same in all documents, so equal texts share theirs
        uses = ents.select(F.xxhash64(text).alias(name), F.explode(found).alias("x")).select(name, F.explode(_parts(F.col("x.kind"), F.col("x.norm"))).alias("x")).select(name, "x.*").distinct()
        label = F.concat("part", F.lit("|"), "norm")
        maps = uses.join(more, ["part", "norm"]).groupBy(name).agg(F.map_from_entries(F.collect_set(F.struct(label, F.struct("attempt", "gender")))).alias(at))
        ents = ents.withColumn(name, F.xxhash64(text)).join(maps, name, "left")
        known = lambda part, norm: F.try_element_at(F.col(at), F.concat(part, F.lit("|"), norm))

    def new(x: Column) -> Column:
        is_name = x["kind"] == "name"
        part, norm = F.when(is_name, "family").otherwise(x["kind"]), F.when(is_name, family_of(x["norm"])).otherwise(x["norm"])
        given = known(F.lit("given"), x["norm"])
        attempts = (F.coalesce(known(part, norm)["attempt"], F.lit(0)), F.coalesce(given["gender"], F.when(is_name, gender_of(x["e"])).otherwise("n")), F.coalesce(given["attempt"], F.lit(0)))
        return surrogate(x["e"], x["kind"], x["norm"], *attempts, key)

    rest = F.split(F.col(text), ANY, -1)
    bare = lambda c: F.regexp_replace(c, "^" + _FORM, "")
    pairs = lambda stand: F.transform(F.filter(F.zip_with(found, stand, lambda a, b: F.struct(a["kind"].alias("kind"), a["e"].alias("e"), b.alias("b"))), lambda x: x["kind"] == "name"), lambda x: F.struct(bare(x["e"]).alias("old"), bare(x["b"]).alias("new")))
    weave = lambda stand: F.array_join(F.zip_with(rest, stand, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    woven = _let(F.transform(found, new), lambda stand: _let(pairs(stand), lambda names: F.when(F.size(names) > 0, _bare(weave(stand), F.array_distinct(names))).otherwise(weave(stand))))
    some = F.size(found) > 0
    kind = F.col(found)["kind"]
    tally = F.filter(F.array(*(F.concat(F.lit(f"{t}:"), (F.size(found) - F.size(F.array_remove(kind, t))).cast("string")) for t in TYPES)), lambda s: ~s.endswith(":0"))
    counts = [F.size(found).alias("n_entities"), F.when(some, F.array_join(tally, ",")).otherwise("").alias("entity_types")] if report else []
    columns = [F.when(some, woven).otherwise(F.col(text)).alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns if not report or c.lower() not in ("n_entities", "entity_types")]
    return ents.select(*columns, *counts)
