"""PII surrogates: detected entities get keyed, type-consistent replacements of the same format, distinct and coreferent.

An entity is an e-mail address, phone number, IPv4 address, card or account number (13 to 19 digits), US social security number, IBAN,
secret (a value after a word such as token, or a key by its look) or a person's name: what follows a title, or a surname after a common
given name. Where a person is named so, all later words of that name in the document are entities too. A surrogate is computed from a hash
of (key, kind, canonical form): a digit stays a digit, a letter a letter of its case and script, separators stay, and so do the country
code, trunk digit and class of a phone number, the top domain of an address and the country of an IBAN; a card number that passes the Luhn
test still does; names come from lists for the person's gender and for the script.

Coreference: equal canonical forms have the same surrogate everywhere, however they are written. A phone number's form has its country code,
whether the text gives it or its layout tells it (ten digits of North America, French pairs, a German area code). A person's gender is
decided over all mentions: that of the titles if they agree, else that of a known given name, else open.

Distinctness: names of one script, given or last, are one space each, whatever their gender; other kinds are spaces of their own. A
surrogate that an original of its space has, or that a smaller form already got, is drawn again with the next attempt until all are
distinct. Late attempts lengthen surrogates, so this ends however small a format is.

Texts are searched once, by one pattern with a group for each kind, and written in parts; entities are resolved in tables of their own, where
hot ones are looked up in a broadcast list, and only texts with entities are joined with what replaces these. Only DataFrame expressions
run. A null text stays null; rows that share an id are each rewritten; a table without rows or entities gives its rows back. Other columns
are not read by `replace_entities` and are kept by `masked_documents`. Intermediate tables of entities are deleted, the last with the process.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.pools import FEMALE_NAMES, LAST_NAMES, MALE_NAMES
from veilspark.llm.frames import heavy_keys, looked_up
from veilspark.llm.tables import written
from veilspark.sources.scratch import discard

LENGTHEN = 6
# Attempts from which names are double, and double with letters.
DOUBLE, LETTERED = 1, 3

# What is detected. The order matters where two patterns start at one place.
TITLES_MALE = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Г-н", "Κύριος"]
TITLES_FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Г-жа", "Κυρία"]
TITLES_OPEN = ["Dr", "Prof"]
# Common given names of English, French, German and Spanish that are no common words.
GIVEN_FEMALE = (
    "Alice Amanda Amelia Andrea Angela Anna Anne Barbara Beatrice Brigitte Camille Caroline Catherine Charlotte Chloe Christina Claudia Cristina Diana Elena "
    "Elizabeth Ella Emily Emma Eva Francesca Gabriela Hannah Heather Helen Ingrid Isabella Jennifer Jessica Julia Karen Katharina Laura Linda Lisa Louise Lucia "
    "Margaret Maria Marie Martha Michelle Monika Nancy Natalie Nicole Olivia Patricia Rachel Rebecca Sandra Sarah Sofia Sophie Stephanie Susan Teresa Theresa "
    "Valentina Victoria Yvonne"
).split()
GIVEN_MALE = (
    "Adam Alan Alejandro Alexander Andreas Andrew Anthony Antonio Benjamin Bernard Brian Carlos Charles Christopher Daniel David Diego Dominic Edward Eric "
    "Ethan Fernando Francisco Franz Frederick George Gregory Hans Heinrich Henri Henry Ignacio Jacob Jacques James Javier Jeffrey Johann John Jonathan Jorge Joseph "
    "Juan Julien Karl Kenneth Kevin Klaus Laurent Lukas Manuel Martin Matthew Michael Miguel Nicholas Olivier Pablo Patrick Paul Pedro Peter Philippe Pierre Raymond "
    "Richard Robert Roland Ronald Samuel Stefan Stephen Steven Thomas Timothy Walter Werner William Wolfgang"
).split()
CYRILLIC_FEMALE = ["Анна", "Мария", "Ольга", "Елена", "Ирина", "Татьяна", "Наталья", "Светлана", "Вера", "Нина", "Галина", "Дарья"]
CYRILLIC_MALE = ["Иван", "Пётр", "Сергей", "Алексей", "Дмитрий", "Николай", "Андрей", "Михаил", "Павел", "Олег", "Роман", "Юрий"]
CYRILLIC_LAST = ["Орленко", "Бондаренко", "Шевченко", "Черных", "Белых", "Долгих", "Седых", "Ткаченко", "Гриненко", "Савченко", "Мельник", "Коваль"]
GREEK_FEMALE = ["Ελένη", "Μαρία", "Άννα", "Σοφία", "Ειρήνη", "Δήμητρα", "Αθηνά", "Ζωή", "Χαρά", "Νίκη"]
GREEK_MALE = ["Γιώργος", "Νίκος", "Κώστας", "Γιάννης", "Δημήτρης", "Πέτρος", "Ανδρέας", "Σπύρος", "Μιχάλης", "Παύλος"]
GREEK_LAST = ["Παππά", "Δούκα", "Λάμπρου", "Γεωργίου", "Δημητρίου", "Νικολάου", "Πέτρου", "Ιωάννου", "Αντωνίου", "Οικονόμου"]
NAME = r"\p{Lu}[\p{L}'’-]*\p{Ll}[\p{L}'’-]*+(?!\p{N})"
CAPITALS = r"\p{Lu}[\p{Lu}'’-]++(?![\p{L}\p{N}])"
INITIALS = r"(?:\p{Lu}\. ?){0,2}"
KEYED = r"(?:token|secret|password|passwd|api[_-]?key|access[_-]?key|private[_-]?key|auth[_-]?key)"
TITLES = "|".join(TITLES_MALE + TITLES_FEMALE + TITLES_OPEN)
UPPER_TITLES = TITLES.upper()
FRENCH, GERMAN = r"0[1-9](?:[ .-]?\d{2}){4}", r"0\d{2,4}[ /-]\d{5,8}"
PATTERNS = {
    "secret": rf"(?<!_)(?i:{KEYED})\W{{1,6}}[A-Za-z0-9_+/=.-]*?\d[A-Za-z0-9_+/=-]{{7,}}",
    "email": r"(?<![._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]+\.)+[A-Za-z]{2,24}",
    "key": r"(?:[0-9a-fA-F]{32,128}|AKIA[0-9A-Z]{16}|gh[oprsu]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,})(?![\p{L}\p{N}])",
    "ip": r"(?<![_.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d)",
    "iban": r"(?<!_)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "card": r"(?<![_.])(?:\d{13,19}|(?:\d{4}[ -]){3}\d{4})(?!\w)",
    "phone": r"(?<![_+])(?:\+(?=(?:[ ().-]{0,3}\d){7,15}(?![ .-]?\d))\d{1,3}(?:[ .-]?\(0\))?(?:[ .-]{0,2}(?:\(\d{1,4}\)|\d{1,4})){2,5}(?!\w)"
    r"|(?:1[ .-])?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3}[ .-]\d{4}(?!\w)"
    # National layouts: French pairs, German area codes, ten digits of North America.
    rf"|(?<!\.){FRENCH}(?!\w|\.\d)|(?<!\.){GERMAN}(?!\w)|(?<!\.)[2-9]\d{{2}}[2-9]\d{{6}}(?!\w|\.\d))",
    "ssn": r"(?<!_)\d{3}-\d{2}-\d{4}(?!\w)",
    "person": rf"(?=\p{{Lu}})(?:(?:{TITLES})\.? {INITIALS}{NAME}(?: {NAME}){{0,2}}|(?:{TITLES}|{UPPER_TITLES})(?:\. {INITIALS}{CAPITALS}(?: {CAPITALS}){{0,2}}"
    rf"| {INITIALS}{CAPITALS}(?: {CAPITALS}){{1,2}})|(?:{'|'.join(GIVEN_FEMALE + GIVEN_MALE)}) {INITIALS}{NAME})",
}
KINDS = list(PATTERNS)
# All begin where no letter or digit stands before; each kind has a group of its own.
ANY = rf"(?<![\p{{L}}\p{{N}}])(?=[\p{{L}}\p{{N}}+(._%-])(?:{'|'.join(f'({p})' for p in PATTERNS.values())})"
# Marks put around matches, and between the groups of one. A text that holds the first character has a third after it meanwhile.
ESCAPE, ESCAPED, EDGE, SLOT = "\x01", "\x01\x02", "\x01\x03", "\x01\x04"
MARKED = EDGE + SLOT.join(f"${k + 1}" for k in range(len(PATTERNS))) + EDGE
TITLED = rf"^(?:{TITLES}|{UPPER_TITLES})\.? "
COUNTRY = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _digits(raw: Column) -> Column:
    """Digits of a phone number without a trunk digit in parentheses."""
    return F.regexp_replace(F.regexp_replace(raw, r"\(0\)", ""), r"\D", "")


def _phone(raw: Column) -> Column:
    """Country code and national number, where the text or the layout tells the country; else the digits."""
    d = _digits(raw)
    form = F.when(raw.startswith("+"), F.concat(F.lit("+"), d)).when(raw.rlike(f"^{FRENCH}$"), F.concat(F.lit("+33"), F.substr(d, F.lit(2))))
    form = form.when(raw.rlike(f"^{GERMAN}$"), F.concat(F.lit("+49"), F.substr(d, F.lit(2)))).when(d.rlike(r"^[2-9]\d{2}[2-9]\d{6}$"), F.concat(F.lit("+1"), d))
    return form.when(d.rlike(r"^1[2-9]\d{2}[2-9]\d{6}$"), F.concat(F.lit("+"), d)).otherwise(d)


def _country(form: Column) -> Column:
    """Characters of the plus and country code."""
    return F.length(F.regexp_extract(form, COUNTRY, 0))


def _form(raw: Column, kind: Column) -> Column:
    """Canonical form of a match that is no name."""
    plain = F.when(kind == "email", F.lower(raw)).when(kind == "secret", _value(raw)).when(kind.isin("card", "ssn"), F.regexp_replace(raw, r"\D", ""))
    return plain.when(kind == "phone", _phone(raw)).when(kind == "iban", F.regexp_replace(raw, " ", "")).otherwise(raw)


def _value(raw: Column) -> Column:
    """The secret itself: what stands after the word and its separator."""
    return F.regexp_replace(raw, rf"^(?i:{KEYED})\W+", "")


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"^\p{IsCyrillic}"), "c").when(word.rlike(r"^\p{IsGreek}"), "g").otherwise("l")


def _stream(key: str, kind: Column, form: Column, attempt: Column) -> Column:
    """Hexadecimal digits of a keyed hash, two for each character of the form and some more."""
    seed = F.concat_ws("\x1f", F.lit(key), kind, form, attempt.cast("string"))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.length(form) / 32).cast("int") + 1), lambda i: F.sha2(F.concat_ws("\x1f", seed, i.cast("string")), 256)), "")


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substr(stream, (2 * i + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _pick(letters: str, n: Column) -> Column:
    return F.substr(F.lit(letters), n % len(letters) + 1, F.lit(1))


LOWER, CYRILLIC, GREEK = "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω"


def _same_class(c: Column, n: Column, hexadecimal: Column) -> Column:
    """Another character of the class of c."""
    out = F.when(c.rlike(r"\d"), _pick("0123456789", n)).when(hexadecimal & c.rlike("[a-f]"), _pick("abcdef", n)).when(hexadecimal & c.rlike("[A-F]"), _pick("ABCDEF", n))
    out = out.when(c.rlike("[a-z]"), _pick(LOWER, n)).when(c.rlike("[A-Z]"), _pick(LOWER.upper(), n)).when(~c.rlike(r"\p{L}"), c)
    for script, letters in (("Cyrillic", CYRILLIC), ("Greek", GREEK)):
        out = out.when(c.rlike(rf"[\p{{Is{script}}}&&\p{{Lu}}]"), _pick(letters.upper(), n)).when(c.rlike(rf"\p{{Is{script}}}"), _pick(letters, n))
    return out.when(c.rlike(r"\p{Lu}"), _pick(LOWER.upper(), n)).otherwise(_pick(LOWER, n))


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum modulo 10 of a string of digits."""
    n = F.length(digits)
    d = lambda i: F.substr(digits, (n - i).cast("int"), F.lit(1)).cast("int")
    twice = lambda i: F.when(d(i) > 4, 2 * d(i) - 9).otherwise(2 * d(i))
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda total, i: total + F.when(i % 2 == 1, twice(i)).otherwise(d(i))) % 10


def _name(kind: Column, stream: Column, attempt: Column) -> Column:
    pools = {
        "last-l": LAST_NAMES, "given-f-l": FEMALE_NAMES, "given-m-l": MALE_NAMES, "given-x-l": [*FEMALE_NAMES, *MALE_NAMES],
        "last-c": CYRILLIC_LAST, "given-f-c": CYRILLIC_FEMALE, "given-m-c": CYRILLIC_MALE, "given-x-c": [*CYRILLIC_FEMALE, *CYRILLIC_MALE],
        "last-g": GREEK_LAST, "given-f-g": GREEK_FEMALE, "given-m-g": GREEK_MALE, "given-x-g": [*GREEK_FEMALE, *GREEK_MALE],
    }
    at = lambda k, n: F.conv(F.substr(stream, F.lit(1 + 8 * k), F.lit(8)), 16, 10).cast("long") % n + 1
    drawn = None
    for name, pool in pools.items():
        names = F.array(*[F.lit(x) for x in pool])
        one, two = (F.element_at(names, at(k, len(pool)).cast("int")) for k in (0, 1))
        # When single names are taken: double names, then double names with letters.
        tail = F.array_join(F.transform(F.sequence(F.lit(0), attempt - LETTERED + 1), lambda i: _pick(LOWER, _byte(stream, i + 8))), "")
        name_of = F.when(attempt < DOUBLE, one).when(attempt < LETTERED, F.concat(one, F.lit("-"), two)).otherwise(F.concat(one, F.lit("-"), two, tail))
        drawn = F.when(kind == name, name_of) if drawn is None else drawn.when(kind == name, name_of)
    return drawn


def surrogate(key: str, kind: Column, form: Column, attempt: Column) -> Column:
    """Replacement of a canonical form, itself in canonical form (names with a capital)."""
    drawn = lambda stream: F.when(kind.contains("-"), _name(kind, stream, attempt)).when(kind == "ip", _address(stream)).otherwise(_let(_mapped(kind, form, stream), lambda new: _finished(kind, form, attempt, stream, new)))
    return _let(_stream(key, kind, form, attempt), drawn)


def _address(stream: Column) -> Column:
    return F.concat_ws(".", *[(_byte(stream, F.lit(i)) % 254 + 1).cast("string") for i in range(4)])


def _mapped(kind: Column, form: Column, stream: Column) -> Column:
    """The form with each character drawn anew, but for what stays."""
    n = F.length(form)
    domain = F.when(kind == "email", n - F.length(F.substring_index(form, ".", -1))).otherwise(n)
    # The first digit of a national number tells its class, in North America the fourth as well; a zero that begins plain digits is a trunk.
    head = F.when(kind == "phone", F.when(form.startswith("+"), _country(form) + 1).when(form.startswith("0"), 1).otherwise(0)).when(kind == "iban", 2)
    head = head.when(kind == "key", F.length(F.regexp_extract(form, r"^(AKIA|gh[oprsu]_|sk-|xox[abprs]-)", 0))).otherwise(0)
    hexadecimal = (kind == "key") & form.rlike("^[0-9a-fA-F]+$")
    char = lambda i: F.substr(form, i + 1, F.lit(1))
    new = lambda bounds: F.array_join(
        F.transform(F.sequence(F.lit(0), n - 1), lambda i: _let(char(i), lambda c: F.when((i < bounds["head"]) | (i >= bounds["domain"]) | (i == bounds["also"]), c).otherwise(_let(_byte(stream, i), lambda b: _same_class(c, b, bounds["hex"]))))), ""
    )
    also = F.when((kind == "phone") & form.startswith("+1"), 5).otherwise(-1)
    return _let(F.struct(head.alias("head"), domain.alias("domain"), hexadecimal.alias("hex"), also.alias("also")), new)


def _finished(kind: Column, form: Column, attempt: Column, stream: Column, new: Column) -> Column:
    """A card number that passed the Luhn test passes it again; late attempts gain characters."""
    n = F.length(form)
    body = F.substr(new, F.lit(1), n - 1)
    check = ((10 - _luhn_sum(F.concat(body, F.lit("0")))) % 10).cast("string")
    more = lambda letters: F.array_join(F.transform(F.sequence(F.lit(0), attempt - LENGTHEN), lambda i: _pick(letters, _byte(stream, i + n))), "")
    late = attempt >= LENGTHEN
    plain = F.when((kind == "card") & ~late, F.when(_luhn_sum(form) == 0, F.concat(body, check)).otherwise(new)).otherwise(new)
    return F.when(late & (kind == "email"), F.concat(more(LOWER), new)).when(late, F.concat(new, more("0123456789"))).otherwise(plain)


def _dialled(raw: Column, form: Column, new: Column) -> Column:
    """A phone number's new national digits in place of the last digits of the match, which keeps its country code or trunk digit."""
    national = F.length(form) - _country(form)
    taken = F.substr(new, _country(form) + 1, F.length(new))
    char = lambda i: F.substr(raw, i + 1, F.lit(1))
    # Digits of the match from a place on: the last `national` of them are replaced.
    left = lambda i: F.length(F.regexp_replace(F.substr(raw, i + 1, F.length(raw)), r"\D", ""))
    one = lambda i: _let(national - left(i), lambda k: F.when(char(i).rlike(r"\d") & (k >= 0), F.substr(taken, k + 1, F.lit(1))).otherwise(char(i)))
    return F.concat(F.array_join(F.transform(F.sequence(F.lit(0), F.length(raw) - 1), one), ""), F.substr(taken, national + 1, F.length(taken)))


def _laid_out(raw: Column, kind: Column, form: Column, new: Column) -> Column:
    """The new canonical form written as the match was."""
    size = F.length(raw)
    char = lambda i: F.substr(raw, (i + 1).cast("int"), F.lit(1))
    before = lambda i, what: F.length(F.regexp_replace(F.substr(raw, F.lit(1), i.cast("int")), what, ""))
    filled = lambda what: F.concat(
        F.array_join(F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.when(char(i).rlike(what), char(i)).otherwise(F.substr(new, (before(i, what) + 1).cast("int"), F.lit(1)))), ""),
        F.substr(new, (F.length(form) + 1).cast("int"), F.length(new)),
    )
    # Letters an address gained at its front are lower case; the rest takes the case of the match.
    gained = F.length(new) - size
    cased = F.array_join(
        F.transform(F.sequence(F.lit(0), F.length(new) - 1), lambda i: F.when((i >= gained) & char(i - gained).rlike(r"\p{Lu}"), F.upper(F.substr(new, (i + 1).cast("int"), F.lit(1)))).otherwise(F.substr(new, (i + 1).cast("int"), F.lit(1)))),
        "",
    )
    put = F.when(kind.isin("card", "ssn"), filled(r"\D")).when(kind == "phone", _dialled(raw, form, new)).when(kind == "iban", filled(" ")).when(kind == "email", cased)
    return put.when(kind == "key", F.concat(F.substr(raw, F.lit(1), (size - F.length(form)).cast("int")), new)).otherwise(new)


def retried(entities: DataFrame, key: str) -> DataFrame:
    """entity (its number), new: distinct surrogates of entities (space, kind, form). Each round is a join on surrogates within a space."""
    originals = entities.select("space", F.lower("form").alias("taken")).distinct()
    pending = entities.select("space", "kind", "form", "entity", F.lit(0).alias("attempt"))
    settled: list[DataFrame] = []
    scrap: list[DataFrame] = []
    while True:
        drawn = pending.withColumn("new", surrogate(key, F.col("kind"), F.col("form"), F.col("attempt")))
        drawn = written(drawn.withColumn("taken", F.lower("new")), "drawn")
        least = drawn.groupBy("space", "taken").agg(F.min("entity").alias("entity")).withColumn("first", F.lit(True))
        gone = reduce(DataFrame.unionByName, [d.select("space", "taken") for d in settled], originals).distinct().withColumn("used", F.lit(True))
        judged = drawn.join(least, ["space", "taken", "entity"], "left").join(gone, ["space", "taken"], "left").withColumn("ok", F.coalesce("first", F.lit(False)) & F.col("used").isNull())
        judged = written(judged.drop("first", "used"), "judged")
        scrap += [drawn, judged]
        settled.append(judged.where("ok").select("entity", "space", "taken", "new"))
        pending = judged.where("NOT ok").select("space", "kind", "form", "entity", (F.col("attempt") + 1).alias("attempt"))
        if pending.isEmpty():
            result = written(reduce(DataFrame.unionByName, settled).select("entity", "new"), "surrogates")
            discard(*scrap)
            return result


def _parted(docs: DataFrame, text_col: str) -> DataFrame:
    """The documents with a number of the row and, for their text, its parts: every second one is a match, as one slot for each kind."""
    text = F.col(f"`{text_col}`")
    marked = F.regexp_replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPED)), ANY, MARKED)
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    return written(docs.select(*others, F.monotonically_increasing_id().alias("__row"), F.split(marked, EDGE, -1).alias("__parts")), "parted")


def _mentions(parted: DataFrame) -> DataFrame:
    """row, at, kind, raw of each match."""
    some = parted.where(F.size("__parts") > 1).select("__row", F.posexplode("__parts").alias("at", "slots")).where("at % 2 = 1")
    slots = F.split("slots", SLOT, -1)
    which = F.array_position(F.transform(slots, lambda x: x != ""), True)
    return some.select(F.col("__row").alias("row"), "at", F.element_at(F.array(*map(F.lit, KINDS)), which.cast("int")).alias("kind"), F.element_at(slots, which.cast("int")).alias("raw"))


def _pieces(mentions: DataFrame) -> DataFrame:
    """row, at, piece, kind, space, form, raw, lead: an entity for each mention, or for each word of a name. `lead` is what stands before it."""
    name = F.regexp_replace("raw", TITLED, "")
    title = F.regexp_replace(F.regexp_extract("raw", TITLED, 0), r"\.? $", "")
    initials = F.regexp_extract(name, rf"^{INITIALS}", 0)
    words = F.split(F.substr(name, F.length(initials) + 1, F.length(name)), " ")
    persons = mentions.where("kind = 'person'").withColumn("words", words).withColumn("lead", F.substr("raw", F.lit(1), F.length("raw") - F.length(F.array_join("words", " "))))
    upper = lambda names: [x.upper() for x in names]
    persons = persons.withColumns(
        {
            "person": F.lower(F.array_join("words", " ")), "male": title.isin(TITLES_MALE + upper(TITLES_MALE)).cast("int"),
            "female": title.isin(TITLES_FEMALE + upper(TITLES_FEMALE)).cast("int"),
        }
    )
    persons = written(persons, "persons")
    first = F.substring_index("person", " ", 1)
    known = lambda *lists: first.isin([x.lower() for names in lists for x in names])
    gender = F.when((F.col("male") > 0) & (F.col("female") == 0), "m").when((F.col("female") > 0) & (F.col("male") == 0), "f")
    gender = gender.when(known(GIVEN_FEMALE, FEMALE_NAMES, CYRILLIC_FEMALE, GREEK_FEMALE), "f").when(known(GIVEN_MALE, MALE_NAMES, CYRILLIC_MALE, GREEK_MALE), "m").otherwise("x")
    genders = persons.groupBy("person").agg(F.sum("male").alias("male"), F.sum("female").alias("female"), F.count("*").alias("rows"))
    genders = written(genders.withColumn("gender", gender), "genders")
    spread = F.concat_ws(":", F.lit("row"), "row", "at")
    persons = looked_up(persons, "person", genders, "person", heavy_keys(genders, "rows"), spread, gender="gender")
    each = persons.select("row", "at", "lead", "gender", F.size("words").alias("many"), F.posexplode("words").alias("piece", "raw"))
    role = F.when(F.col("piece") == F.col("many") - 1, "last").otherwise("given")
    each = each.withColumns({"script": _script(F.col("raw")), "role": role})
    named = each.select(
        "row", "at", "piece", F.concat_ws("-", "role", F.when(F.col("role") == "given", F.col("gender")), "script").alias("kind"),
        F.concat_ws("-", "role", "script").alias("space"), F.lower("raw").alias("form"), "raw", F.when(F.col("piece") == 0, F.col("lead")).otherwise(" ").alias("lead"),
    )
    # A key has one surrogate whether a word such as token stands before it or not.
    kind = F.when(F.col("kind") == "secret", "key").otherwise(F.col("kind"))
    others = mentions.where("kind <> 'person'").withColumn("form", _form(F.col("raw"), F.col("kind")))
    others = others.select("row", "at", F.lit(0).alias("piece"), kind.alias("kind"), kind.alias("space"), "form", "raw", F.lit("").alias("lead"))
    return written(named.unionByName(others), "pieces")


def _resolved(pieces: DataFrame, key: str) -> DataFrame:
    """The pieces with their surrogates."""
    numbered = pieces.withColumn("entity", F.concat_ws("\x1f", "kind", "form"))
    entities = written(numbered.groupBy("entity", "kind", "space", "form").agg(F.count("*").alias("rows")), "entities")
    surrogates = retried(entities, key)
    heavy = surrogates.join(F.broadcast(heavy_keys(entities, "rows").select("entity")), "entity", "left_semi")
    found = written(looked_up(numbered, "entity", surrogates, "entity", heavy, F.concat_ws(":", F.lit("row"), "row", "at", "piece"), new="new"), "resolved")
    discard(entities, surrogates)
    return found


def _per_row(resolved: DataFrame) -> DataFrame:
    """row, puts (replacement of each match in order), words and news (each word of the row's names, as it is written, and its surrogate)."""
    name = F.col("kind").contains("-")
    cased = lambda raw: F.when(raw.rlike(r"^\P{Ll}+$") & (F.length(raw) > 1), F.upper("new")).otherwise(F.col("new"))
    put = F.when(name, F.concat("lead", cased(F.col("raw")))).otherwise(_laid_out(F.col("raw"), F.col("kind"), F.col("form"), F.col("new")))
    puts = resolved.withColumn("put", put).groupBy("row", "at").agg(F.array_sort(F.collect_list(F.struct("piece", "put"))).alias("x"))
    puts = puts.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", F.array_join("x.put", "").alias("put")))).alias("puts"))
    # Single letters stay, and a word has one surrogate in a text even if it is given and last name there.
    written_as = F.explode(F.array(F.concat(F.upper(F.substr("raw", F.lit(1), F.lit(1))), F.substr(F.lower("raw"), F.lit(2), F.length("raw"))), F.col("raw"), F.upper("raw")))
    words = resolved.where(name & (F.length("raw") > 2)).select("row", "new", written_as.alias("word")).groupBy("row", "word").agg(F.min("new").alias("new"))
    words = words.select("row", "word", cased(F.col("word")).alias("new"))
    words = words.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("word", "new"))).alias("words"))
    return puts.join(words, "row", "left").select(F.col("row").alias("__row"), F.col("puts.put").alias("__puts"), F.col("words.word").alias("__words"), F.col("words.new").alias("__news"))


def masked_documents(docs: DataFrame, key: str = "surrogates", text_col: str = "text") -> DataFrame:
    """The documents with their entities replaced in the text, and `__entities`: how many places were replaced."""
    parted = _parted(docs, text_col)
    mentions = _mentions(parted)
    pieces = _pieces(mentions)
    resolved = _resolved(pieces, key)
    per_row = written(_per_row(resolved), "replacements")
    discard(pieces, resolved)
    plain = parted.where(F.coalesce(F.size("__parts"), F.lit(0)) <= 1).withColumns({"__text": F.element_at("__parts", 1), "__entities": F.lit(0).cast("long")})
    joined = parted.where(F.size("__parts") > 1).join(per_row, "__row")
    # Words of the row's names in what stands between the matches.
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])("), F.array_join("__words", "|"), F.lit(r")(?![\p{L}\p{N}])"))
    pattern = F.when(F.size("__words") > 0, pattern)
    joined = joined.withColumn("__pattern", pattern)
    of_word = lambda w: F.element_at(F.col("__news"), F.array_position("__words", w).cast("int"))
    renamed = lambda part: F.transform(F.split(F.regexp_replace(part, F.col("__pattern"), F.lit(f"{EDGE}$1{EDGE}")), EDGE, -1), lambda x, i: F.when(i % 2 == 1, of_word(x)).otherwise(x))
    between = lambda part: F.when(F.col("__pattern").isNull(), F.array(part)).otherwise(renamed(part))
    lists = F.transform("__parts", lambda x, i: F.when(i % 2 == 1, F.array(F.element_at("__puts", ((i + 1) / 2).cast("int")))).otherwise(between(x)))
    joined = joined.withColumn("__lists", lists)
    # Of n pieces of a part between matches every second is a replaced word.
    places = F.aggregate(F.transform("__lists", lambda x, i: F.when(i % 2 == 1, 1).otherwise(F.floor(F.size(x) / 2)).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    joined = joined.withColumns({"__text": F.array_join(F.flatten("__lists"), ""), "__entities": places})
    text = F.replace(F.col("__text"), F.lit(ESCAPED), F.lit(ESCAPE)).alias(text_col)
    kept = [text if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return plain.select(*kept, "__entities").unionByName(joined.select(*kept, "__entities"))


def replace_entities(docs: DataFrame, key: str = "surrogates", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, text with surrogates, n_entities."""
    frame = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return masked_documents(frame, key).withColumnRenamed("__entities", "n_entities")
