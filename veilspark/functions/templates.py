"""Text templates: symbol patterns (``#?*``) and ``{{CATEGORY.FIELD}}`` names, both as samplers."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable

from veilspark.functions import domains as d
from veilspark.functions import pools as p

EPOCH_2020 = dt.datetime(2020, 1, 1)
YEAR_END_2023 = dt.datetime(2023, 12, 31)


def symbols(pattern: str) -> d.Sampler:
    """``#`` a digit, ``?`` a capital letter, ``*`` either; anything else stands for itself."""
    pieces: list[str | d.Sampler] = []
    for run in re.findall(r"#+|\?+|\*+|[^#?*]+", pattern):
        if run[0] == "#":
            pieces.extend(d.digits(len(run[i : i + 15])) for i in range(0, len(run), 15))
        elif run[0] == "?":
            pieces.append(d.characters(p.LETTERS_UPPER, len(run)))
        elif run[0] == "*":
            pieces.append(d.characters(p.DIGITS + p.LETTERS_UPPER, len(run)))
        else:
            pieces.append(run)
    return d.concat(*pieces)


def sentence() -> d.Sampler:
    """A filler sentence of three phrases."""
    return d.concat(d.pool(p.SUBJECTS), " ", d.pool(p.PREDICATES), " ", d.pool(p.ENDINGS), ".")


def filler(sentences: int, separator: str = " ", limit: int | None = None) -> d.Sampler:
    """Sentences of filler text; no more of them than ``limit`` characters can hold."""
    if limit is not None:
        shortest = sum(min(map(len, phrases)) + 1 for phrases in (p.SUBJECTS, p.PREDICATES, p.ENDINGS))
        sentences = max(1, min(sentences, -(-limit // shortest)))
    pieces: list[str | d.Sampler] = [sentence()]
    for _ in range(sentences - 1):
        pieces += [separator, sentence()]
    return d.concat(*pieces)


def first_name() -> d.Sampler:
    return d.pool(p.FEMALE_NAMES + p.MALE_NAMES)


def last_name() -> d.Sampler:
    return d.pool(p.LAST_NAMES)


def full_name() -> d.Sampler:
    return d.concat(first_name(), " ", last_name())


def user_name() -> d.Sampler:
    return d.concat(first_name(), d.pool([".", "_"]), last_name(), d.digits(2))


def company_name() -> d.Sampler:
    return d.concat(d.pool(p.COMPANY_STEMS), " ", d.pool(p.COMPANY_FIELDS))


def city() -> d.Sampler:
    return d.concat(d.pool(p.CITY_STEMS), d.pool(p.CITY_SUFFIXES))


def street_name() -> d.Sampler:
    return d.concat(d.pool(p.STREET_STEMS), " ", d.pool(p.STREET_SUFFIXES))


def building_number() -> d.Sampler:
    return d.mapped(d.integers(100, 99999), lambda v: v.cast("string"))


def street_address() -> d.Sampler:
    return d.concat(building_number(), " ", street_name())


def secondary_address() -> d.Sampler:
    return d.concat(d.pool(["Apt. ", "Suite "]), d.digits(3))


def full_address() -> d.Sampler:
    return d.concat(street_address(), ", ", city(), ", ", d.pool(p.COUNTRIES))


def file_stem() -> d.Sampler:
    return d.concat(d.pool(p.WORDS), "_", d.pool(p.WORDS), "_", d.pool(p.WORDS))


def _word() -> d.Sampler:
    return d.pool(p.WORDS)


def _words(n: int, separator: str = " ") -> d.Sampler:
    return d.concat(_word(), *[x for _ in range(n - 1) for x in (separator, _word())])


def _job() -> d.Sampler:
    return d.concat(d.pool(p.JOB_DESCRIPTORS), " ", d.pool(p.JOB_AREAS), " ", d.pool(p.JOB_TYPES))


def _number(low: int, high: int) -> d.Sampler:
    return d.mapped(d.integers(low, high), lambda v: v.cast("string"))


def _decimal(low: str, high: str, scale: int) -> d.Sampler:
    kind = f"decimal(18,{scale})"
    return d.mapped(d.decimals(low, high, scale, kind), lambda v: v.cast("string"))


def _guid() -> d.Sampler:
    part = [d.characters(p.HEX_DIGITS, n) for n in (8, 4, 4, 4, 12)]
    return d.concat(part[0], "-", part[1], "-", part[2], "-", part[3], "-", part[4])


def _ip() -> d.Sampler:
    return d.concat(_number(0, 255), ".", _number(0, 255), ".", _number(0, 255), ".", _number(0, 255))


def _joined_hex(groups: int, width: int) -> d.Sampler:
    pieces: list[str | d.Sampler] = [d.characters(p.HEX_DIGITS, width)]
    for _ in range(groups - 1):
        pieces += [":", d.characters(p.HEX_DIGITS, width)]
    return d.concat(*pieces)


def _date_text(low: dt.datetime = EPOCH_2020, high: dt.datetime = YEAR_END_2023) -> d.Sampler:
    return d.formatted(d.seconds(low, high), "yyyy-MM-dd HH:mm:ss")


def _url() -> d.Sampler:
    return d.concat(d.pool(p.PROTOCOLS), "://", _word(), ".", d.pool(p.DOMAIN_SUFFIXES))


def _file_name() -> d.Sampler:
    return d.concat(file_stem(), ".", d.pool(p.FILE_EXTENSIONS))


_ALPHANUMERIC = p.LETTERS_LOWER + p.DIGITS

# CATEGORY.FIELD names accepted in a template; the names are fixed values.
FIELDS: dict[str, Callable[[], d.Sampler]] = {
    "RANDOMIZER.NUMBER": lambda: _number(0, 1),
    "RANDOMIZER.DIGITS": lambda: d.digits(4),
    "RANDOMIZER.EVEN": lambda: d.mapped(d.integers(0, 49), lambda v: (v * 2).cast("string")),
    "RANDOMIZER.ODD": lambda: d.mapped(d.integers(0, 49), lambda v: (v * 2 + 1).cast("string")),
    "RANDOMIZER.DOUBLE": lambda: _decimal("0", "1", 6),
    "RANDOMIZER.DECIMAL": lambda: _decimal("0", "1", 6),
    "RANDOMIZER.FLOAT": lambda: _decimal("0", "1", 6),
    "RANDOMIZER.BYTE": lambda: _number(0, 255),
    "RANDOMIZER.SBYTE": lambda: _number(-128, 127),
    "RANDOMIZER.INT": lambda: _number(-(2**31), 2**31 - 1),
    "RANDOMIZER.UINT": lambda: _number(0, 2**32 - 1),
    "RANDOMIZER.LONG": lambda: _number(-(10**15), 10**15),
    "RANDOMIZER.ULONG": lambda: _number(0, 10**15),
    "RANDOMIZER.SHORT": lambda: _number(-(2**15), 2**15 - 1),
    "RANDOMIZER.USHORT": lambda: _number(0, 2**16 - 1),
    "RANDOMIZER.CHAR": lambda: d.characters(_ALPHANUMERIC, 1),
    "RANDOMIZER.STRING": lambda: d.characters(p.LETTERS_LOWER + p.LETTERS_UPPER, 40),
    "RANDOMIZER.STRING2": lambda: d.characters(p.LETTERS_LOWER, 10),
    "RANDOMIZER.HASH": lambda: d.characters(p.HEX_DIGITS, 40),
    "RANDOMIZER.BOOL": lambda: d.pool(["True", "False"]),
    "RANDOMIZER.WORD": _word,
    "RANDOMIZER.WORDS": lambda: _words(3),
    "RANDOMIZER.GUID": _guid,
    "RANDOMIZER.UUID": _guid,
    "RANDOMIZER.ALPHANUMERIC": lambda: d.characters(_ALPHANUMERIC, 10),
    "RANDOMIZER.HEXADECIMAL": lambda: d.concat("0x", d.characters(p.HEX_DIGITS, 1)),
    "HACKER.ABBREVIATION": lambda: d.pool(p.HACKER_ABBREVIATIONS),
    "HACKER.ADJECTIVE": lambda: d.pool(p.HACKER_ADJECTIVES),
    "HACKER.NOUN": lambda: d.pool(p.HACKER_NOUNS),
    "HACKER.VERB": lambda: d.pool(p.HACKER_VERBS),
    "HACKER.INGVERB": lambda: d.pool(p.HACKER_ING_VERBS),
    "HACKER.PHRASE": lambda: d.concat(
        "We need to ", d.pool(p.HACKER_VERBS), " the ", d.pool(p.HACKER_ADJECTIVES), " ",
        d.pool(p.HACKER_ABBREVIATIONS), " ", d.pool(p.HACKER_NOUNS), "!",
    ),
    "PHONE_NUMBER.PHONENUMBER": lambda: symbols("###-###-####"),
    "PHONE_NUMBER.PHONENUMBERFORMAT": lambda: symbols("(###) ###-####"),
    "NAME.FIRSTNAME": first_name,
    "NAME.LASTNAME": last_name,
    "NAME.FULLNAME": full_name,
    "NAME.FINDNAME": full_name,
    "NAME.PREFIX": lambda: d.pool(p.NAME_PREFIXES),
    "NAME.SUFFIX": lambda: d.pool(p.NAME_SUFFIXES),
    "NAME.JOBTITLE": _job,
    "NAME.JOBDESCRIPTOR": lambda: d.pool(p.JOB_DESCRIPTORS),
    "NAME.JOBAREA": lambda: d.pool(p.JOB_AREAS),
    "NAME.JOBTYPE": lambda: d.pool(p.JOB_TYPES),
    "LOREM.WORD": _word,
    "LOREM.WORDS": lambda: _words(3),
    "LOREM.LETTER": lambda: d.characters(p.LETTERS_LOWER, 1),
    "LOREM.SENTENCE": sentence,
    "LOREM.SENTENCES": lambda: filler(3, "\n"),
    "LOREM.PARAGRAPH": lambda: filler(3),
    "LOREM.PARAGRAPHS": lambda: filler(3, "\n\n"),
    "LOREM.TEXT": lambda: filler(4),
    "LOREM.LINES": lambda: filler(3, "\n"),
    "LOREM.SLUG": lambda: _words(3, "-"),
    "IMAGE.PICSUMURL": lambda: d.concat("https://images.example.com/640/480/?image=", _number(0, 1084)),
    "IMAGE.PLACEHOLDERURL": lambda: d.concat("https://images.example.com/640x480/", d.characters(p.HEX_DIGITS, 6)),
    "IMAGE.IMAGE": lambda: d.concat("https://images.example.com/640/480/", d.pool(p.IMAGE_TOPICS)),
    **{f"IMAGE.{t.upper()}": (lambda t=t: d.concat(f"https://images.example.com/640/480/{t}/", _number(1, 1000))) for t in p.IMAGE_TOPICS},
    "FINANCE.ACCOUNT": lambda: d.digits(8),
    "FINANCE.ACCOUNTNAME": lambda: d.concat(d.pool(p.ACCOUNT_NAMES), " Account"),
    "FINANCE.AMOUNT": lambda: _decimal("0", "1000", 2),
    "FINANCE.TRANSACTIONTYPE": lambda: d.pool(p.TRANSACTIONS),
    "FINANCE.CURRENCY": lambda: d.pool(p.CURRENCIES),
    "FINANCE.CREDITCARDNUMBER": lambda: symbols("####-####-####-####"),
    "FINANCE.CREDITCARDCVV": lambda: d.digits(3),
    "FINANCE.BITCOINADDRESS": lambda: d.concat("1", d.characters(p.LETTERS_LOWER + p.DIGITS, 32)),
    "FINANCE.ETHEREUMADDRESS": lambda: d.concat("0x", d.characters(p.HEX_DIGITS, 40)),
    "FINANCE.ROUTINGNUMBER": lambda: d.digits(9),
    "FINANCE.BIC": lambda: symbols("????US##"),
    "FINANCE.IBAN": lambda: symbols("GB##????##############"),
    "ADDRESS.ZIPCODE": lambda: d.digits(5),
    "ADDRESS.CITY": city,
    "ADDRESS.CITYPREFIX": lambda: d.pool(p.CITY_PREFIXES),
    "ADDRESS.CITYSUFFIX": lambda: d.pool(p.CITY_SUFFIXES),
    "ADDRESS.STREETADDRESS": street_address,
    "ADDRESS.STREETNAME": street_name,
    "ADDRESS.STREETSUFFIX": lambda: d.pool(p.STREET_SUFFIXES),
    "ADDRESS.BUILDINGNUMBER": building_number,
    "ADDRESS.SECONDARYADDRESS": secondary_address,
    "ADDRESS.COUNTY": lambda: d.pool(p.COUNTIES),
    "ADDRESS.COUNTRY": lambda: d.pool(p.COUNTRIES),
    "ADDRESS.COUNTRYCODE": lambda: d.pool(p.COUNTRY_CODES),
    "ADDRESS.FULLADDRESS": full_address,
    "ADDRESS.STATE": lambda: d.pool(p.STATES["UnitedStates"]),
    "ADDRESS.STATEABBR": lambda: d.pool(p.STATE_CODES),
    "ADDRESS.LATITUDE": lambda: _decimal("-90", "90", 4),
    "ADDRESS.LONGITUDE": lambda: _decimal("-180", "180", 4),
    "ADDRESS.DIRECTION": lambda: d.pool(p.CARDINAL + p.ORDINAL),
    "ADDRESS.CARDINALDIRECTION": lambda: d.pool(p.CARDINAL),
    "ADDRESS.ORDINALDIRECTION": lambda: d.pool(p.ORDINAL),
    "DATE.PAST": _date_text,
    "DATE.RECENT": lambda: _date_text(dt.datetime(2023, 12, 30), YEAR_END_2023),
    "DATE.BETWEEN": _date_text,
    "DATE.SOON": lambda: _date_text(dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)),
    "DATE.FUTURE": lambda: _date_text(dt.datetime(2024, 1, 1), dt.datetime(2024, 12, 31)),
    "DATE.TIMESPAN": lambda: d.formatted(d.seconds(EPOCH_2020, dt.datetime(2020, 1, 1, 23, 59, 59)), "HH:mm:ss"),
    "DATE.MONTH": lambda: d.pool(p.MONTHS),
    "DATE.WEEKDAY": lambda: d.pool(p.WEEKDAYS),
    "DATABASE.COLUMN": lambda: d.pool(p.DATABASE_COLUMNS),
    "DATABASE.TYPE": lambda: d.pool(p.DATABASE_TYPES),
    "DATABASE.COLLATION": lambda: d.pool(p.DATABASE_COLLATIONS),
    "DATABASE.ENGINE": lambda: d.pool(p.DATABASE_ENGINES),
    "COMPANY.COMPANYNAME": company_name,
    "COMPANY.COMPANYSUFFIX": lambda: d.pool(p.COMPANY_SUFFIXES),
    "COMPANY.CATCHPHRASE": lambda: d.concat(d.pool(p.CATCH_ADJECTIVES), " ", d.pool(p.HACKER_ADJECTIVES), " ", d.pool(p.CATCH_NOUNS)),
    "COMPANY.BS": lambda: d.concat(d.pool(p.HACKER_VERBS), " ", d.pool(p.HACKER_ADJECTIVES), " ", d.pool(p.CATCH_NOUNS)),
    "INTERNET.AVATAR": lambda: d.concat("https://images.example.com/avatar/", _number(0, 1249), ".jpg"),
    "INTERNET.EMAIL": lambda: d.concat(user_name(), "@", d.pool(p.MAIL_HOSTS)),
    "INTERNET.EXAMPLEEMAIL": lambda: d.concat(user_name(), "@", d.pool(p.MAIL_HOSTS)),
    "INTERNET.USERNAME": user_name,
    "INTERNET.DOMAINNAME": lambda: d.concat(_word(), ".", d.pool(p.DOMAIN_SUFFIXES)),
    "INTERNET.DOMAINWORD": _word,
    "INTERNET.DOMAINSUFFIX": lambda: d.pool(p.DOMAIN_SUFFIXES),
    "INTERNET.IP": _ip,
    "INTERNET.IPV6": lambda: _joined_hex(8, 4),
    "INTERNET.USERAGENT": lambda: d.pool(p.USER_AGENTS),
    "INTERNET.MAC": lambda: _joined_hex(6, 2),
    "INTERNET.PASSWORD": lambda: d.characters(p.LETTERS_LOWER + p.LETTERS_UPPER + p.DIGITS, 10),
    "INTERNET.COLOR": lambda: d.concat("#", d.characters(p.HEX_DIGITS, 6)),
    "INTERNET.PROTOCOL": lambda: d.pool(p.PROTOCOLS),
    "INTERNET.URL": _url,
    "INTERNET.URLWITHPATH": lambda: d.concat(_url(), "/", _word()),
    "COMMERCE.DEPARTMENT": lambda: d.pool(p.DEPARTMENTS),
    "COMMERCE.PRICE": lambda: _decimal("1", "1000", 2),
    "COMMERCE.CATEGORIES": lambda: d.pool(p.DEPARTMENTS),
    "COMMERCE.PRODUCTNAME": lambda: d.concat(d.pool(p.PRODUCT_ADJECTIVES), " ", d.pool(p.PRODUCT_MATERIALS), " ", d.pool(p.PRODUCTS)),
    "COMMERCE.COLOR": lambda: d.pool(p.COLORS),
    "COMMERCE.PRODUCT": lambda: d.pool(p.PRODUCTS),
    "COMMERCE.PRODUCTADJECTIVE": lambda: d.pool(p.PRODUCT_ADJECTIVES),
    "COMMERCE.PRODUCTMATERIAL": lambda: d.pool(p.PRODUCT_MATERIALS),
    "COMMERCE.EAN8": lambda: d.digits(8),
    "COMMERCE.EAN13": lambda: d.digits(13),
    "SYSTEM.FILENAME": _file_name,
    "SYSTEM.COMMONFILENAME": _file_name,
    "SYSTEM.DIRECTORYPATH": lambda: d.pool(p.DIRECTORIES),
    "SYSTEM.FILEPATH": lambda: d.concat(d.pool(p.DIRECTORIES), "/", _file_name()),
    "SYSTEM.MIMETYPE": lambda: d.pool(p.MIME_TYPES),
    "SYSTEM.FILETYPE": lambda: d.pool(p.FILE_TYPES),
    "SYSTEM.COMMONFILETYPE": lambda: d.pool(p.FILE_TYPES),
    "SYSTEM.FILEEXT": lambda: d.pool(p.FILE_EXTENSIONS),
    "SYSTEM.COMMONFILEEXT": lambda: d.pool(p.FILE_EXTENSIONS),
    "SYSTEM.SEMVER": lambda: d.concat(_number(0, 9), ".", _number(0, 9), ".", _number(0, 9)),
    "SYSTEM.VERSION": lambda: d.concat(_number(0, 9), ".", _number(0, 9), ".", _number(0, 9), ".", _number(0, 9)),
    "SYSTEM.ANDROIDID": lambda: d.concat("APA91", d.characters(p.LETTERS_LOWER + p.DIGITS, 32)),
    "SYSTEM.APPLEPUSHTOKEN": lambda: d.characters(p.HEX_DIGITS, 64),
    "SYSTEM.BLACKBERRYPIN": lambda: d.characters(p.HEX_DIGITS, 8),
}

_FIELD = re.compile(r"\{\{\s*([^{}]+?)\s*\}\}")


def template(text: str) -> d.Sampler:
    """Text with ``{{CATEGORY.FIELD}}`` names, matched without regard to case; unknown names are an error."""
    pieces: list[str | d.Sampler] = []
    position = 0
    for match in _FIELD.finditer(text):
        if match.start() > position:
            pieces.append(text[position : match.start()])
        name = match.group(1).upper()
        if name not in FIELDS:
            raise ValueError(f"unknown template field {match.group(1)!r}")
        pieces.append(FIELDS[name]())
        position = match.end()
    if position < len(text):
        pieces.append(text[position:])
    return d.concat(*pieces)
