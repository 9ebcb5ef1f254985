"""Made-up values in place of personal ones.

A value's replacement follows from the value and the salt alone, so that equal
values stay equal and reruns agree. Numbers come from the first 32 bits of an
MD5 of a tag, the salt and the value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnflow.functions.masks import choose

FIRST = "Ada Ben Cora Dan Eva Finn Gwen Hugo Iris Jon Kira Leo Mara Nils Olga Paul Rosa Sven Tara Uwe Vera Wim Yara Zoe".split()
LAST = "Adler Brook Castle Dunn Ember Frost Grove Hale Ivory Jarvis Kerr Lowe Marsh North Oakes Pryor Quill Reed Stone Thorn Usher Vale West York".split()
STREETS = "Birch Cedar Elm Fir Hazel Juniper Larch Maple Oak Pine Rowan Spruce".split()
KINDS = "Street Avenue Road Lane".split()
HOSTS = "example.com example.net example.org".split()
COUNTRIES = "GB DE FR IT ES NL BE CH".split()


def number(c: Column, tag: str, salt: str = "") -> Column:
    """A number below 2**32 that the value decides."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{tag}:{salt}:"), c).cast("binary")), 1, 8), 16, 10).cast("bigint")


def pick(c: Column, options: list[str], tag: str, salt: str = "") -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (number(c, tag, salt) % len(options) + 1).cast("int"))


def digits(c: Column, n: int, tag: str, salt: str = "") -> Column:
    """``n`` digits."""
    sizes = [8] * (n // 8) + [n % 8] * bool(n % 8)
    return F.concat(*(F.lpad((number(c, f"{tag}{i}", salt) % 10**k).cast("string"), k, "0") for i, k in enumerate(sizes)))


def fake_name(c: Column, salt: str = "") -> Column:
    return F.concat(pick(c, FIRST, "first", salt), F.lit(" "), pick(c, LAST, "last", salt))


def fake_email(c: Column, salt: str = "") -> Column:
    return F.concat(F.lower(pick(c, FIRST, "first", salt)), F.lit("."), F.lower(pick(c, LAST, "last", salt)), digits(c, 4, "mail", salt), F.lit("@"), pick(c, HOSTS, "host", salt))


def fake_phone(c: Column, salt: str = "") -> Column:
    return F.concat(F.lit("+1-"), (number(c, "area", salt) % 800 + 200).cast("string"), F.lit("-555-"), digits(c, 4, "line", salt))


def fake_address(c: Column, salt: str = "") -> Column:
    return F.concat((number(c, "house", salt) % 9899 + 100).cast("string"), F.lit(" "), pick(c, STREETS, "street", salt), F.lit(" "), pick(c, KINDS, "kind", salt))


def fake_ssn(c: Column, salt: str = "") -> Column:
    return F.concat(digits(c, 3, "ssn-a", salt), F.lit("-"), digits(c, 2, "ssn-b", salt), F.lit("-"), digits(c, 4, "ssn-c", salt))


def fake_credit_card(c: Column, salt: str = "") -> Column:
    """Sixteen digits that pass the Luhn check."""
    body = F.concat(F.lit("4"), digits(c, 14, "card", salt))
    # from the right of the body, every other digit doubles, beginning with the last
    place = lambda i: F.substring(body, i, 1).cast("int")
    total = sum(((place(i) * 2) % 10 + F.floor(place(i) * 2 / 10).cast("int")) if i % 2 else place(i) for i in range(1, 16))
    return F.concat(body, ((10 - total % 10) % 10).cast("string"))


def fake_iban(c: Column, salt: str = "") -> Column:
    country = F.when(F.length(c) >= 2, F.left(c, F.lit(2))).otherwise(pick(c, COUNTRIES, "country", salt))
    return F.concat(country, digits(c, 20, "iban", salt))


def fake_us_bank_account(c: Column, salt: str = "") -> Column:
    return F.concat(F.lit("Routing: "), digits(c, 9, "routing", salt), F.lit(", Account: "), digits(c, 10, "account", salt))


def fake_ca_bank_account(c: Column, salt: str = "") -> Column:
    return F.concat(digits(c, 5, "transit", salt), F.lit("-"), digits(c, 3, "bank", salt), F.lit("-"), digits(c, 10, "account", salt))


def fake_ip_address(c: Column, salt: str = "") -> Column:
    part = lambda t: (number(c, t, salt) % 256).cast("string")
    return F.concat_ws(".", (number(c, "ip0", salt) % 223 + 1).cast("string"), part("ip1"), part("ip2"), part("ip3"))


FAKE_OF = {
    "EMAIL_ADDRESS": fake_email,
    "PERSON": fake_name,
    "PHONE_NUMBER": fake_phone,
    "US_SSN": fake_ssn,
    "CREDIT_CARD": fake_credit_card,
    "IBAN_CODE": fake_iban,
    "IP_ADDRESS": fake_ip_address,
    "LOCATION": fake_address,
    "US_BANK_ACCOUNT": fake_us_bank_account,
    "CA_BANK_ACCOUNT": fake_ca_bank_account,
}


def smart_fake(c: Column, entity_type: str | None = None, salt: str = "") -> Column:
    by_kind = {k: (lambda x, f=f: f(x, salt)) for k, f in FAKE_OF.items()}
    return choose(c, entity_type, by_kind, digits(c, 10, "id", salt))
