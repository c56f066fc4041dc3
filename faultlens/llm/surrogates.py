"""Replacement of personal data by surrogates. DataFrame operations only.

Detected entities are mail addresses, payment cards (Luhn), phone numbers, IPv4 addresses, US social security
numbers, IBANs, access keys, IPv6 addresses, assigned secrets (password=..., token = "..."), and names behind a title. Each is taken
apart into literal parts and values; every value gets a keyed surrogate of its own type and form: digits stay
digits, letters letters of the same case, script and (hex) alphabet; an IPv4 address keeps its octets' lengths and its
range (private, loopback, link-local, shared, documentation and other reserved ones keep what makes them so, public
ones stay public), a card its first digit and a valid check digit, an IBAN its country and valid check digits, a mail
address's domain its last label; a given name becomes one of the same gender and script, a family name a made-up one
of the same script. Values are replaced alike wherever they stand, part by part, so mentions still corefer (Mr. A.
Smith and Mr. Smith, two mail users of one host). Names found in a document are also replaced where they stand there
without a title, as whole words or parts of hyphenated ones (Smith said; Smith's; Smiths Haus); a word that was found
both as a family and as a given name counts as the former. Capitals make no difference to a name or a mail address:
MR. SMITH, Smith and SMITH are one value, and each mention's surrogate is written in its own capitals. Titles are found
as they are listed and all in capitals; of a name of two words with a hyphen each word is a value (Smith-Jones holds
Smith's surrogate). Phone numbers without any separator and local ones without an area code are not looked for, as they
look like other numbers.

Collision check: over all distinct values, two values of a type with the same surrogate, or a surrogate that is
itself a value found in the texts, are given new ones from the next attempt of the key; checked again until none is
left. So surrogates are one to one within a type. The space of every type grows with the attempt, so no number of
distinct values exhausts it: after every 4 attempts names get two more syllables, users, hosts, domains and secrets
two more characters, phone numbers two more digits, and an address's octets may have other lengths. Forms of fixed
length grow only when they are nearly used up, after every 16 attempts: cards, social security numbers, IBANs and
access keys by four characters, addresses by an octet.

Scale: the patterns run over each text once, into a stored table; only documents with entities are joined to their
surrogates, others pass by. Distinct values combine on the map side, so a value found in a third of all rows is one
row a task, and so do the contestants for a surrogate; a text that a large share of all rows holds meets its
surrogates in salted copies. An attempt only works on the values that are still open. Results: a null text stays
null, an empty one empty; a text without entities is unchanged; repeated rows are replaced alike; all columns are kept,
whatever their names (the added ones get underscores where the input has their names); an empty table gives an empty
result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultlens.llm.shared import delete, fresh, joined_hot, stored

# Titles by gender, and given names by gender and script
TITLES_M = ["Mr", "Mister", "Herr", "Monsieur", "Señor", "Sr", "господин", "г-н"]
TITLES_F = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Sra", "госпожа", "г-жа"]
TITLES_N = ["Dr", "Prof", "Professor", "Doktor", "доктор"]
GIVEN = {
    ("f", "latin"): ["Alice", "Beatrix", "Clara", "Dorothea", "Emilia", "Frieda", "Greta", "Helena", "Ingrid", "Johanna", "Katarina", "Luisa", "Marlene", "Nadine", "Odette", "Paula", "Rosalie", "Sabine", "Theresa", "Viola"],
    ("m", "latin"): ["Adrian", "Bertram", "Conrad", "Dominik", "Edgar", "Florian", "Gustav", "Hector", "Ivan", "Jasper", "Konstantin", "Leopold", "Magnus", "Norbert", "Oscar", "Philipp", "Ruben", "Sebastian", "Tobias", "Victor"],
    ("n", "latin"): ["Alex", "Robin", "Kim", "Sascha", "Dominique", "Camille", "Jules", "Noel", "Rene", "Toni", "Quinn", "Rowan", "Ariel", "Morgan", "Avery", "Sidney"],
    ("f", "cyrillic"): ["Анна", "Вера", "Галина", "Дарья", "Елена", "Зоя", "Ирина", "Ксения", "Лидия", "Мария", "Надежда", "Ольга"],
    ("m", "cyrillic"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Лев", "Максим", "Никита", "Олег"],
    ("n", "cyrillic"): ["Саша", "Женя", "Валя", "Шура", "Слава", "Паша"],
}
SYLLABLES = {
    "latin": ["ba", "den", "ker", "lo", "mar", "nel", "os", "pra", "ril", "san", "tev", "ul", "var", "wen", "yor", "zim"],
    "cyrillic": ["ба", "вен", "гор", "дил", "кар", "лем", "мов", "нор", "пал", "рус", "сев", "тим", "фор", "хан", "чер", "юл"],
}

# Further given names whose gender is known behind a title without one
KNOWN = {
    "f": ["Anna", "Maria", "Laura", "Sarah", "Julia", "Emma", "Sophie", "Marie", "Elena", "Lucia", "Carmen", "Isabel", "Ana", "Claire", "Jane", "Mary", "Linda", "Susan", "Karen", "Petra", "Monika", "Ursula", "Nina", "Eva"],
    "m": ["John", "Peter", "Hans", "Michael", "Thomas", "David", "James", "Robert", "William", "Paul", "Pierre", "Jean", "Louis", "Carlos", "Juan", "Pedro", "Miguel", "Luis", "Klaus", "Karl", "Stefan", "Andreas", "Martin", "Daniel"],
}

_NAME = r"(?:\p{Lu}\.|\p{Lu}[\p{L}'’]+(?:-\p{Lu}[\p{L}'’]+)*)"
_TITLES = [*TITLES_M, *TITLES_F, *TITLES_N]
_TITLE = "|".join(sorted({*_TITLES, *(t.upper() for t in _TITLES)}, key=lambda t: (-len(t), t)))
EMAIL = r"(?<![\w.+%-])[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"
SECRET = r"(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key)\s*[=:]\s*\"?)[^\s\"<>|&*!?$%#,;]{6,}"
ACCESS = r"(?<!\w)(?:AKIA|ASIA)[0-9A-Z]{16}(?!\w)"
IBAN = r"(?<!\w)[A-Z]{2}\d{2}(?:(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?|(?: ?[A-Z0-9]{4}){2} ?[A-Z0-9]{3})(?!\w)"
IP = r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d)"
CARD = r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?!\w)"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
IP6 = r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]*\d)(?:[0-9A-Fa-f]{1,4}:){2,6}(?::[0-9A-Fa-f]{1,4}){1,5}|(?=[0-9A-Fa-f]{0,3}\d)[0-9A-Fa-f]{3,4}:(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])"
PHONE = r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3}[ .-]\d{4}(?!\w)|(?<!\w)\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\w)"
NAME = rf"(?<![\p{{L}}\d])(?:{_TITLE})\.?[ \u00a0]{_NAME}(?:[ \u00a0]{_NAME}){{0,3}}"
HINT = rf"[0-9@=:]|AKIA|ASIA|(?:{_TITLE})\.?[ \u00a0]\p{{Lu}}"  # every entity has one of these; quick to search for
WORD = r"\p{L}+(?:[-'’]\p{L}+)*|[^\p{L}]+"
# IPv4 ranges that are not public, by the octets that make them so; (first, second from, second to)
RANGES_1 = [0, 10, 127, *range(224, 256)]
RANGES_2 = [(100, 64, 127), (169, 254, 254), (172, 16, 31), (192, 168, 168), (198, 18, 19)]
RANGES_3 = ["192.0.0", "192.0.2", "192.88.99", "198.51.100", "203.0.113"]
PUBLIC_3 = [o for o in range(101, 224) if o not in (127, 169, 172, 192, 198, 203)]
ENTITY = "|".join(f"(?:{p})" for p in (EMAIL, SECRET, ACCESS, NAME, IBAN, IP6, IP, SSN, CARD, PHONE))


def luhn(number: Column) -> Column:
    """Whether the digits of a string end in a valid check digit."""
    digits = F.reverse(F.split(F.regexp_replace(number, r"\D", ""), ""))
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def mod97(number: Column) -> Column:
    """The remainder of a number whose letters stand for 10 to 35; spaces do not count."""
    chars = F.filter(F.split(F.translate(number, " ", ""), ""), lambda c: c != "")
    step = lambda a, c: F.when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(chars, F.lit(0), step)


def _part(kind: Column | str, value: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), value.alias("value"))


def _script(value: Column) -> Column:
    return F.when(value.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic")).otherwise(F.lit("latin"))


def parts(match: Column) -> Column:
    """A match as an array of (kind, value); kind '' is literal text."""
    title = F.regexp_extract(match, rf"^(?:{_TITLE})\.?", 0)
    bare = F.regexp_replace(title, r"\.$", "")
    words = F.regexp_extract_all(F.regexp_replace(match, rf"^(?:{_TITLE})\.?", ""), F.lit(r"[ \u00a0]|[^ \u00a0]+"), F.lit(0))
    n = F.size(words)
    titled = lambda titles: F.upper(bare).isin([t.upper() for t in titles])
    said = F.when(titled(TITLES_M), F.lit("m")).when(titled(TITLES_F), F.lit("f"))

    def word(w: Column, i: Column) -> Column:
        """The parts of a word; a hyphenated one has a part for each name in it."""
        known = [F.arrays_overlap(F.split(F.lower(w), "-"), F.array(*[F.lit(x.lower()) for x in [*GIVEN[(g, "latin")], *GIVEN[(g, "cyrillic")], *KNOWN[g]]])) for g in "mf"]
        gender = F.coalesce(said, F.when(known[0], F.lit("m")).when(known[1], F.lit("f")), F.lit("n"))
        kind = F.when(w.rlike("^[ \u00a0]$") | w.rlike(r"^\p{L}\.$"), F.lit("")).when(i == n - 1, F.lit("family")).otherwise(F.concat(F.lit("given_"), gender))
        return F.transform(F.regexp_extract_all(w, F.lit("[^-]+|-"), F.lit(0)), lambda x: _part(F.when(x == "-", F.lit("")).otherwise(kind), x))

    name = F.concat(F.array(_part("", title)), F.flatten(F.transform(words, word)))
    lead = F.regexp_extract(match, r'^(?i:(?:password|passwd|pwd|secret|token|api[_-]?key)\s*[=:]\s*"?)', 0)
    secret = F.array(_part("", lead), _part("secret", F.regexp_replace(match, r'^(?i:(?:password|passwd|pwd|secret|token|api[_-]?key)\s*[=:]\s*"?)', "")))
    host = F.regexp_extract(match, r"@(.*?)((?:[A-Za-z0-9-]+\.)?[A-Za-z]{2,})$", 1)
    base = F.regexp_extract(match, r"@(.*?)((?:[A-Za-z0-9-]+\.)?[A-Za-z]{2,})$", 2)
    domain = F.regexp_extract(match, r"([A-Za-z0-9-]+)\.[A-Za-z]{2,}$", 1)
    top = F.regexp_extract(match, r"\.([A-Za-z]{2,})$", 1)
    reserved = domain.isin("example", "test", "invalid")
    mail = F.concat(
        F.array(_part("user", F.regexp_extract(match, "^([^@]*)@", 1)), _part("", F.lit("@"))),
        F.when(host != "", F.array(_part("host", host))).otherwise(F.array().cast("array<struct<kind:string,value:string>>")),
        F.when(reserved, F.array(_part("", base))).otherwise(F.array(_part("domain", domain), _part("", F.concat(F.lit("."), top)))),
    )
    whole = F.array(
        _part(
            F.when(match.rlike(f"^(?:{ACCESS})$"), F.lit("access"))
            .when(match.rlike(f"^(?:{IBAN})$"), F.lit("iban"))
            .when(match.rlike(f"^(?:{IP})$"), F.lit("ip"))
            .when(match.rlike(f"^(?:{IP6})$"), F.lit("ip6"))
            .when(match.rlike(f"^(?:{SSN})$"), F.lit("ssn"))
            .when(match.rlike(f"^(?:{CARD})$") & luhn(match), F.lit("card"))
            .when(match.rlike(f"^(?:{PHONE})$"), F.lit("phone"))
            .otherwise(F.lit("")),
            match,
        )
    )
    return F.when(match.rlike(f"^(?:{EMAIL})$"), mail).when(lead != "", secret).when(title != "", name).otherwise(whole)


def _shaped(value: Column, stream: Column, hexadecimal: Column) -> Column:
    """value with every letter and digit replaced by one of its own sort, chosen by a stream of hex digits."""

    def pick(alphabet: str, h: Column) -> Column:
        return F.substring(F.lit(alphabet), F.pmod(h, F.lit(len(alphabet))) + 1, F.lit(1))

    def one(c: Column, i: Column) -> Column:
        h = F.conv(F.substring(stream, F.pmod(i * 4, F.lit(240)) + 1, F.lit(4)), 16, 10).cast("int") + i
        return (
            F.when(c.rlike("^[0-9]$"), pick("0123456789", h))
            .when(hexadecimal & c.rlike("^[a-f]$"), pick("abcdef", h))
            .when(hexadecimal & c.rlike("^[A-F]$"), pick("ABCDEF", h))
            .when(c.rlike("^[a-z]$"), pick("abcdefghijklmnopqrstuvwxyz", h))
            .when(c.rlike("^[A-Z]$"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", h))
            .when(c.rlike(r"^[\u0430-\u044f]$"), pick("абвгдежзиклмнопрстуфхцчшщэюя", h))
            .when(c.rlike(r"^[\u0410-\u042f]$"), pick("АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ", h))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _let(value: Column, body) -> Column:
    """body(value), with value computed once and not written out wherever body uses it."""
    return F.transform(F.array(value), body)[0]


def surrogate(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    """The surrogate of a value at an attempt; a function of its arguments alone, capitals aside where they are folded."""
    value = folded(kind, value)
    base = F.concat_ws("\u0001", F.lit(key), kind, attempt.cast("string"), value)
    stream = F.concat(F.sha2(base, 512), F.sha2(F.concat(base, F.lit("+")), 512))
    hexadecimal = value.rlike("^(?:[0-9a-f]{16,}|[0-9A-F]{16,})$") | (kind == "ip6")
    return _let(stream, lambda s: _let(_shaped(value, s, hexadecimal), lambda shaped: _surrogate(kind, value, attempt, s, shaped)))


def _surrogate(kind: Column, value: Column, attempt: Column, stream: Column, shaped: Column) -> Column:
    number = lambda at, n: F.pmod(F.conv(F.substring(stream, at, 6), 16, 10).cast("int"), F.lit(n))
    octet = lambda i, n: F.pmod(F.conv(F.substring(stream, i * 6 + 1, F.lit(6)), 16, 10).cast("int"), F.lit(n))
    first = F.substring(value, 1, 1)
    grown, late = F.floor(attempt / 4).cast("int"), F.floor(attempt / 16).cast("int")
    digits = lambda n: F.substring(F.translate(F.substring(stream, F.lit(129), F.lit(128)), "abcdef", "012345"), F.lit(1), n)
    own_octets = F.split(value, r"\.")
    near = lambda i: F.try_element_at(own_octets, i + 1).cast("int")
    first_two = [F.when((near(F.lit(0)) == a) & near(F.lit(1)).between(low, high), octet(F.lit(1), high - low + 1) + low) for a, low, high in RANGES_2]
    kept = F.when(F.array_join(F.slice(own_octets, 1, 3), ".").isin(RANGES_3), 3).when(near(F.lit(0)).isin(RANGES_1), 1).otherwise(0)

    def octets(sized: Column, most: Column) -> Column:
        """An address in the range of value's; sized: whether octets keep their lengths."""
        public = F.element_at(F.array(*[F.lit(o) for o in PUBLIC_3]), octet(F.lit(0), len(PUBLIC_3)) + 1)
        leads = [F.when(F.length(own_octets[0]) == 1, octet(F.lit(0), 9) + 1).when(F.length(own_octets[0]) == 2, octet(F.lit(0), 89) + 11).otherwise(public), octet(F.lit(0), 9) + 1]

        def one(i: Column, kept_: Column, ranged: Column) -> Column:
            long_ = F.length(F.coalesce(F.try_element_at(own_octets, i + 1), F.lit("0")))
            plain = F.when(sized & (long_ == 1), octet(i, 9) + 1).when(sized & (long_ == 2), octet(i, 90) + 10).when(sized, octet(i, 155) + 100).otherwise(octet(i, 254) + 1)
            lead = F.when(ranged.isNotNull(), near(F.lit(0))).when(sized, leads[0]).otherwise(F.when(octet(F.lit(9), 2) == 0, public).otherwise(leads[1]))
            return F.when(i < kept_, near(i)).when(i == 0, lead).when((i == 1) & ranged.isNotNull(), ranged).otherwise(plain).cast("string")

        each = lambda r: F.transform(F.sequence(F.lit(0), most), lambda i: one(i, kept, r))
        return F.array_join(_let(F.coalesce(*first_two), each), ".")

    card_body = F.concat(first, F.substring(shaped, F.lit(2), F.length(shaped) - 2), digits(late * 4))
    check = lambda body: F.coalesce(*[F.when(luhn(F.concat(body, F.lit(str(d)))), F.lit(str(d))) for d in range(10)])
    phone = F.concat(F.regexp_extract(value, r"^(\+\d{1,3})?", 0), F.substring(shaped, F.length(F.regexp_extract(value, r"^(\+\d{1,3})?", 0)) + 1, F.length(shaped)), digits(grown * 2))
    access = F.concat(F.substring(value, 1, 4), F.substring(shaped, F.lit(5), F.length(shaped)), digits(late * 4))
    country, account = F.substring(value, 1, 2), F.concat(F.substring(shaped, F.lit(5), F.length(shaped)), digits(late * 4))
    iban = _let(account, lambda x: F.concat(country, F.lpad((98 - mod97(F.concat(x, country, F.lit("00")))).cast("string"), 2, "0"), x))
    script = _script(value)

    def chosen(lists: dict[str, list[str]], at: int | Column) -> Column:
        pick = lambda names: F.element_at(F.array(*[F.lit(n) for n in names]), number(at, len(names)) + 1)
        return F.when(script == "cyrillic", pick(lists["cyrillic"])).otherwise(pick(lists["latin"]))

    def more(at: int) -> Column:
        """Two syllables for every 4 attempts, from position `at` of the stream on."""
        made = F.array_join(F.transform(F.sequence(F.lit(0), grown * 2 - 1), lambda i: chosen(SYLLABLES, i * 6 + at)), "")
        return F.when(grown > 0, made).otherwise(F.lit(""))

    own = lambda g: chosen({s: GIVEN[(g, s)] for s in ("latin", "cyrillic")}, 1)
    first_name = F.when(kind == "given_m", own("m")).when(kind == "given_f", own("f")).otherwise(own("n"))
    longer_name = F.concat(first_name, F.lit("-"), F.initcap(F.concat(chosen(SYLLABLES, 7), chosen(SYLLABLES, 13), more(19))))
    family = F.initcap(F.concat(chosen(SYLLABLES, 1), chosen(SYLLABLES, 7), chosen(SYLLABLES, 13), chosen(SYLLABLES, 19), more(25)))
    name = F.when(kind == "family", family).when(attempt == 0, first_name).otherwise(longer_name)
    cased = lambda made: F.when((F.upper(value) == value) & (F.length(value) > 1), F.upper(made)).otherwise(made)
    extra = F.substring(stream, F.lit(1), grown * 2)
    longer = F.concat(shaped, extra)
    host = F.concat(F.regexp_replace(shaped, r"\.$", ""), extra, F.lit("."))
    return (
        F.when(kind == "ip", octets(grown == 0, late + 3))
        .when(kind == "card", _let(card_body, lambda body: F.concat(body, check(body))))
        .when(kind == "phone", phone)
        .when(kind == "access", access)
        .when(kind == "iban", iban)
        .when(kind.isin("given_m", "given_f", "given_n", "family"), _let(name, cased))
        .when(kind == "host", host)
        .when(kind == "ssn", F.concat(shaped, digits(late * 4)))
        .when(kind.isin("user", "secret", "domain"), longer)
        .when(kind == "ip6", F.concat(F.regexp_extract(value, "^[^:]*", 0), F.substring(shaped, F.length(F.regexp_extract(value, "^[^:]*", 0)) + 1, F.length(shaped)), F.when(grown > 0, F.concat(F.lit(":"), F.substring(stream, F.lit(1), F.lit(4)))).otherwise(F.lit(""))))
        .otherwise(shaped)
    )


def entities(text: Column) -> Column:
    """The matches in a text, in order; an empty array for none and for a null text."""
    none = F.array().cast("array<string>")
    return F.when(F.coalesce(text.rlike(HINT), F.lit(False)), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))).otherwise(none)


FOLDED = ("family", "given_m", "given_f", "given_n", "user", "host", "domain")


def folded(kind: Column, value: Column) -> Column:
    """A value as surrogates are keyed by it: names and parts of mail addresses without regard to capitals."""
    return F.when(kind.isin(*FOLDED), F.lower(value)).otherwise(value)


def recased(kind: Column, mention: Column, made: Column) -> Column:
    """A surrogate in the letters of a mention: names in capitals get one in capitals, parts of mail addresses have
    capitals where the mention has them."""
    capitals = (F.upper(mention) == mention) & (F.lower(mention) != mention) & (F.length(mention) > 1)
    letters = F.transform(F.split(made, ""), lambda c, i: F.when(F.substring(mention, i + 1, F.lit(1)).rlike(r"^\p{Lu}$"), F.upper(c)).otherwise(c))
    mixed = kind.isin("user", "host", "domain") & (F.lower(mention) != mention)
    return F.when(mixed, F.array_join(letters, "")).when(kind.isin(*FOLDED) & capitals, F.upper(made)).otherwise(made)


def dictionary(values: DataFrame, key: str, most_attempts: int = 64) -> DataFrame:
    """kind, value, surrogate: one to one within a kind, and no surrogate is a value of its kind, capitals aside."""
    spark, settled, places = values.sparkSession, [], []
    whole = values.select("kind", F.col("value").alias("mention"), folded(F.col("kind"), F.col("value")).alias("value")).distinct()
    values = whole.select("kind", "value").distinct()
    real = values.select("kind", F.col("value").alias("taken"))
    open_ = values
    for attempt in range(most_attempts):
        new = open_.withColumn("surrogate", surrogate(F.col("kind"), F.col("value"), F.lit(attempt), key))
        first = new.groupBy("kind", folded(F.col("kind"), F.col("surrogate")).alias("taken")).agg(F.min(F.struct("value", "surrogate")).alias("m"))
        for other in (real, *settled):
            first = first.join(other.select("kind", "taken"), ["kind", "taken"], "left_anti")
        won, _ = stored(first.select("kind", "m.value", "m.surrogate", "taken"), "surrogates")
        settled.append(won)
        open_, place = stored(open_.join(won, ["kind", "value"], "left_anti"), "surrogates-open")
        places.append(place)
        if open_.isEmpty():
            for place in places:
                delete(spark, place)
            made = whole.join(reduce(DataFrame.unionByName, settled), ["kind", "value"])
            return made.select("kind", F.col("mention").alias("value"), recased(F.col("kind"), F.col("mention"), F.col("surrogate")).alias("surrogate"))
    raise RuntimeError("values without a surrogate of their own are left")


def _looked_up(word: Column, known: Column) -> Column:
    """The surrogate of a word that is a name in the map `known` of (kind, value), preferring family names; also of one
    with an s behind it."""

    def of(w: Column) -> Column:
        return F.coalesce(*[F.try_element_at(known, F.concat_ws("\u0001", F.lit(k), F.lower(w))) for k in ("family", "given_m", "given_f", "given_n")])

    stem = F.regexp_replace(word, "[sS]$", "")
    ended = F.when((stem != word) & (F.length(stem) > 2), F.concat(recased(F.lit("family"), stem, of(stem)), F.right(word, F.lit(1))))
    return F.coalesce(recased(F.lit("family"), word, of(word)), ended)


def _without_names(literal: Column, known: Column) -> Column:
    """Text between entities with the names of the map replaced where they are whole words or parts of such."""
    piece = lambda p: F.coalesce(_looked_up(p, known), p)
    parts_ = lambda w: F.array_join(F.transform(F.regexp_extract_all(w, F.lit(r"\p{L}+|[^\p{L}]"), F.lit(0)), piece), "")
    word = lambda w: F.when(~w.rlike(r"^\p{Lu}"), w).otherwise(F.coalesce(_looked_up(w, known), F.when(w.rlike("[-'’]"), parts_(w)), w))
    return F.array_join(F.transform(F.regexp_extract_all(literal, F.lit(WORD), F.lit(0)), word), "")


def replaced(docs: DataFrame, key: str = "surrogates", keep_counts: bool = True) -> DataFrame:
    """docs with their text replaced, and (keep_counts) n_entities and kinds (array of the kinds of values)."""
    found, row, split, known, kinds = fresh(docs, "found", "key", "parts", "map", "kinds")
    added = ["n_entities", "kinds"]
    for i in range(2):
        while added[i].lower() in {c.lower() for c in docs.columns}:
            added[i] += "_"
    tagged, _ = stored(docs.withColumn(found, entities(F.col("text"))), "entity-tags")
    some = tagged.where(F.size(found) > 0).withColumn(split, F.transform(found, parts)).withColumn(row, F.sha2("text", 256))
    each = some.select(row, F.explode(F.array_distinct(F.flatten(split))).alias("p")).where("p.kind <> ''").select(row, "p.kind", folded(F.col("p.kind"), F.col("p.value")).alias("value")).distinct()
    each, _ = stored(each, "entities")
    names = dictionary(each.select("kind", "value").distinct(), key)
    maps = (
        each.join(names, ["kind", "value"])
        .groupBy(row)
        .agg(F.collect_list(F.struct(F.concat_ws("\u0001", "kind", "value"), "surrogate")).alias("m"), F.array_sort(F.collect_set("kind")).alias(kinds))
        .select(row, F.map_from_entries("m").alias(known), kinds)
    )
    said = lambda match: F.array_join(
        F.transform(match, lambda p: F.when(p["kind"] == "", p["value"]).otherwise(recased(p["kind"], p["value"], F.try_element_at(F.col(known), F.concat_ws("\u0001", p["kind"], folded(p["kind"], p["value"])))))), ""
    )
    changed = joined_hot(some, maps, row)
    has_name = F.exists(F.col(kinds), lambda k: (k == "family") | k.startswith("given_"))
    literals = F.split("text", ENTITY, -1)
    literals = F.when(has_name, F.transform(literals, lambda t: _without_names(t, F.col(known)))).otherwise(literals)
    text = F.array_join(F.zip_with(literals, F.transform(split, said), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    counted = F.size(F.filter(split, lambda m: F.exists(m, lambda p: p["kind"] != "")))
    extra = [F.when(F.col(known).isNull(), 0).otherwise(counted).alias(added[0]), F.coalesce(kinds, F.array().cast("array<string>")).alias(added[1])] if keep_counts else []
    new = changed.select(*[(F.when(F.col(known).isNull(), F.col("text")).otherwise(text).alias("text") if c == "text" else F.col(f"`{c}`")) for c in docs.columns], *extra)
    none = [F.lit(0).alias(added[0]), F.array().cast("array<string>").alias(added[1])] if keep_counts else []
    return new.unionByName(tagged.where(F.size(found) == 0).select(*[F.col(f"`{c}`") for c in docs.columns], *none))
