"""Lists that the queries' SQL shares with the code: a change of one is a change of both, so their digests are pinned here."""

import hashlib

import pytest

from veilspark.functions import dates, pools, redact
from veilspark.operators import configure, profile
from veilspark.sources import files


def digest(value) -> str:
    return hashlib.md5(repr(value).encode()).hexdigest()[:10]


LISTS = {
    f"{module.__name__.split('.')[-1]}.{name}": getattr(module, name)
    for module, names in (
        (pools, sorted(n for n in vars(pools) if n.isupper())),
        (redact, ["SIGNATURES"]),
        (configure, ["TEXT_TYPES", "SCRAMBLE_TYPES", "BY_NAME_RULES"]),
        (files, ["SEPARATORS", "SHEET_COLUMNS", "CONFIG_FIELDS"]),
    )
    for name in names
    if hasattr(module, name)
}

PINNED = {
    "pools.ACCOUNT_NAMES": "5b60300a62",
    "pools.CARDINAL": "616eaf7888",
    "pools.CATCH_ADJECTIVES": "55261645cf",
    "pools.CATCH_NOUNS": "a743d92bd8",
    "pools.CITY_PREFIXES": "0d9bf89093",
    "pools.CITY_STEMS": "394908a88f",
    "pools.CITY_SUFFIXES": "f1b429c06c",
    "pools.COLORS": "899666e6de",
    "pools.COMPANY_FIELDS": "4cb0652d8b",
    "pools.COMPANY_STEMS": "ffdec3cfd7",
    "pools.COMPANY_SUFFIXES": "e298f672aa",
    "pools.COUNTIES": "50128edacc",
    "pools.COUNTRIES": "d1a9822702",
    "pools.COUNTRY_CODES": "e2f22e53eb",
    "pools.CURRENCIES": "cf7aa3c8f6",
    "pools.DATABASE_COLLATIONS": "1ee22c89cc",
    "pools.DATABASE_COLUMNS": "3c9f7df533",
    "pools.DATABASE_ENGINES": "c6bdd0583e",
    "pools.DATABASE_TYPES": "30f4c9552a",
    "pools.DEPARTMENTS": "d46a8fa778",
    "pools.DIGITS": "f3645fabc1",
    "pools.DIRECTORIES": "a86ba76a41",
    "pools.DOMAIN_SUFFIXES": "f4731ae9e7",
    "pools.ENDINGS": "9140c0276f",
    "pools.FEMALE_NAMES": "15aa0a0e83",
    "pools.FILE_EXTENSIONS": "5bd21b62e9",
    "pools.FILE_TYPES": "da553a0a05",
    "pools.HACKER_ABBREVIATIONS": "832dd7325b",
    "pools.HACKER_ADJECTIVES": "af2c535712",
    "pools.HACKER_ING_VERBS": "e8edca9e15",
    "pools.HACKER_NOUNS": "c60f918e9b",
    "pools.HACKER_VERBS": "e158b3965a",
    "pools.HEX_DIGITS": "456c577b5a",
    "pools.IMAGE_TOPICS": "e87c2afc1e",
    "pools.JOB_AREAS": "967ca3ac35",
    "pools.JOB_DESCRIPTORS": "bc5066a6ae",
    "pools.JOB_TYPES": "ae97f17a96",
    "pools.LAST_NAMES": "9e0c6e649d",
    "pools.LETTERS_LOWER": "57920e1d91",
    "pools.LETTERS_UPPER": "d46b02bab4",
    "pools.MAIL_HOSTS": "abceb60507",
    "pools.MALE_NAMES": "8cb687f7c7",
    "pools.MIME_TYPES": "e142dfbe53",
    "pools.MONTHS": "e3604a3f3f",
    "pools.NAME_PREFIXES": "aabb747dbf",
    "pools.NAME_SUFFIXES": "1f48160a95",
    "pools.ORDINAL": "db23d94ef8",
    "pools.PLACES": "9247582b36",
    "pools.PLACES_OF": "542b9611d6",
    "pools.PLACE_BOOK": "8f42e8e616",
    "pools.PREDICATES": "af7e5706c3",
    "pools.PRODUCTS": "5e50590d28",
    "pools.PRODUCT_ADJECTIVES": "4dc11b2772",
    "pools.PRODUCT_MATERIALS": "afdb248bc1",
    "pools.PROTOCOLS": "39484bb773",
    "pools.STATES": "ff782d3f54",
    "pools.STATE_CODES": "3114c39a75",
    "pools.STREET_STEMS": "d47e71c47f",
    "pools.STREET_SUFFIXES": "c711cf4111",
    "pools.SUBJECTS": "d14760e0f7",
    "pools.TRANSACTIONS": "cee616eb4c",
    "pools.USER_AGENTS": "ad511d7f0d",
    "pools.VEHICLE_FUELS": "174fa2b42b",
    "pools.VEHICLE_MAKERS": "84e5984806",
    "pools.VEHICLE_MODELS": "ae12d7abce",
    "pools.VEHICLE_TYPES": "3cf868dc49",
    "pools.VERBS": "0bc608d9e5",
    "pools.VIN_ALPHABET": "0e67262caf",
    "pools.WEEKDAYS": "5369839a37",
    "pools.WORDS": "b7f50bc423",
    "configure.TEXT_TYPES": "174d3281eb",
    "configure.SCRAMBLE_TYPES": "d86ddf2943",
    "configure.BY_NAME_RULES": "b7719c3f71",
    "files.SEPARATORS": "8e0b18f460",
    "files.SHEET_COLUMNS": "39ba760df4",
    "files.CONFIG_FIELDS": "a18f33e7f4",
}


@pytest.mark.parametrize("name", sorted(PINNED))
def test_a_shared_list_is_as_it_was(name):
    assert digest(LISTS[name]) == PINNED[name]


def test_every_shared_list_is_pinned():
    assert set(LISTS) == set(PINNED)


def test_accepted_dates():
    assert dates._YEAR_FIRST == ["yyyy-d-M", "yyyy-M-d"] and [*dates._CLOCKS.values()] == ["h:mm:ss a", "h:mm a", "h a", "h:mm:ss", "h:mm"]


def test_type_names_of_the_catalog():
    assert digest(sorted((k.__name__, v) for k, v in profile._TYPE_TEXT.items())) == "7023154bdd"
