"""Masking of personal values, as Catalyst expressions from string column to string column.

Every function takes the column and its parameters. Digits are ASCII digits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def stars(n: Column) -> Column:
    return F.repeat(F.lit("*"), n.cast("int"))


def mask_email(c: Column, min_local_part: int = 5, min_domain_part: int = 5, keep_domain: bool = True) -> Column:
    """First and last two characters of the local part; the domain stays unless it is short or unwanted."""
    for name, value in (("min_local_part", min_local_part), ("min_domain_part", min_domain_part)):
        if isinstance(value, bool) or not isinstance(value, int):
            raise TypeError(f"{name} must be an integer")
    if not isinstance(keep_domain, bool):
        raise TypeError("keep_domain must be a boolean")
    domain = F.substring_index(c, "@", -1)
    local = F.left(c, F.length(c) - F.length(domain) - 1)
    n, d = F.length(local), F.length(domain)
    hidden = F.when(n <= min_local_part, stars(n)).otherwise(F.concat(F.left(local, F.lit(2)), stars(n - 4), F.right(local, F.lit(2))))
    shown = F.when(d <= min_domain_part, stars(d)).otherwise(domain) if keep_domain else stars(d)
    return F.when(F.contains(c, F.lit("@")), F.concat(hidden, F.lit("@"), shown)).otherwise(F.lit("***@***.com"))


def count_digits(c: Column) -> Column:
    return F.length(c) - F.length(F.translate(c, "0123456789", ""))


def mask_digits(c: Column, keep: int, empty: str) -> Column:
    """All digits but the last ``keep``; other characters stay. Too few digits: all characters."""
    digits = count_digits(c)
    hidden = F.regexp_replace(c, f"[0-9](?=(?:[^0-9]*[0-9]){{{keep}}})", "*")
    return F.when(c == "", F.lit(empty)).when(digits < keep, stars(F.length(c))).otherwise(hidden)


def mask_phone(c: Column) -> Column:
    return mask_digits(c, 4, "***-****")


def mask_credit_card(c: Column) -> Column:
    return mask_digits(c, 4, "*" * 12)


def mask_ssn(c: Column) -> Column:
    return mask_digits(c, 4, "***-**-****")


def mask_sin(c: Column) -> Column:
    return mask_digits(c, 3, "***-***-***")


def mask_tin(c: Column) -> Column:
    return mask_digits(c, 4, "*" * 9)


def mask_ip_address(c: Column) -> Column:
    parts = F.split(c, "\\.", -1)
    shown = F.concat(F.get(parts, F.lit(0)), F.lit(".***.*."), F.get(parts, F.lit(3)))
    return F.when(F.size(parts) == 4, shown).otherwise(F.lit("***.***.***.***"))


def mask_iban(c: Column) -> Column:
    n = F.length(c)
    return F.when(n < 6, F.lit("*" * 20)).otherwise(F.concat(F.left(c, F.lit(2)), stars(n - 6), F.right(c, F.lit(4))))


def by_word(c: Column, hide) -> Column:
    """``hide`` on each word; words join by single blanks."""
    words = F.filter(F.split(c, "\\s+", -1), lambda w: w != "")
    return F.array_join(F.transform(words, hide), " ")


def mask_person(c: Column) -> Column:
    return by_word(c, lambda w: F.concat(F.left(w, F.lit(1)), stars(F.greatest(F.lit(1), F.length(w) - 1))))


def mask_location(c: Column) -> Column:
    return by_word(c, lambda w: F.concat(F.left(w, F.lit(3)), stars(F.length(w) - 3)))


def mask_bank_account(c: Column) -> Column:
    """The last four digits of each run of digits stay."""
    return F.regexp_replace(c, "[0-9](?=[0-9]{4})", "*")


def mask_generic(c: Column, keep_first: int = 3, keep_last: int = 3) -> Column:
    n = F.length(c)
    shown = F.concat(F.left(c, F.lit(keep_first)), stars(n - keep_first - keep_last), F.right(c, F.lit(keep_last)) if keep_last else F.lit(""))
    return F.when(n <= keep_first + keep_last, stars(n)).otherwise(shown)


def format_tests(c: Column) -> list[tuple[str, Column]]:
    """The kinds of value that can be told from the text alone, each with its test; the first that holds names the kind."""
    t = F.btrim(c, F.lit(" \t\n\x0b\f\r"))
    digits = count_digits(t)
    return [
        ("EMAIL_ADDRESS", F.contains(t, F.lit("@")) & F.contains(F.substring_index(t, "@", -1), F.lit("."))),
        ("IP_ADDRESS", t.rlike("^[0-9]{1,3}(\\.[0-9]{1,3}){3}$")),
        ("US_SSN", t.rlike("^[0-9]{3}-?[0-9]{2}-?[0-9]{4}$")),
        ("CREDIT_CARD", digits == 16),
        ("PHONE_NUMBER", (digits >= 7) & (t.rlike("[-()+ ]") | (digits >= 10))),
        ("IBAN_CODE", (F.length(t) > 15) & t.rlike("^[A-Za-z]{2}[A-Za-z0-9]+$")),
    ]


def first_of(cases: list[tuple[Column, Column]], otherwise: Column) -> Column:
    """The value of the first case that holds; each test stands in the plan once."""
    return reduce(lambda out, case: out.when(*case), cases[1:], F.when(*cases[0])).otherwise(otherwise)


def detect_format(c: Column) -> Column:
    """The kind of value that the text looks like, first match wins."""
    return first_of([(test, F.lit(kind)) for kind, test in format_tests(c)], F.lit("GENERIC"))


#: Which mask a kind of value gets.
MASK_OF = {
    "EMAIL_ADDRESS": mask_email,
    "PHONE_NUMBER": mask_phone,
    "US_SSN": mask_ssn,
    "CREDIT_CARD": mask_credit_card,
    "IP_ADDRESS": mask_ip_address,
    "IBAN_CODE": mask_iban,
    "PERSON": mask_person,
    "LOCATION": mask_location,
    "US_BANK_ACCOUNT": mask_bank_account,
    "CA_BANK_ACCOUNT": mask_bank_account,
    "CA_SIN": mask_sin,
    "CA_TIN": mask_tin,
}


def choose(c: Column, entity_type: str | None, by_kind: dict, fallback: Column) -> Column:
    """The function of the given kind, or of the kind that each value looks like."""
    if entity_type is not None:
        return by_kind[entity_type](c) if entity_type in by_kind else fallback
    return first_of([(test, by_kind[kind](c) if kind in by_kind else fallback) for kind, test in format_tests(c)], fallback)


def smart_mask(c: Column, entity_type: str | None = None, keep_first: int = 3, keep_last: int = 3) -> Column:
    return choose(c, entity_type, MASK_OF, mask_generic(c, keep_first, keep_last))


def mask_range(c: Column, masking_char: str = "*", chars_to_mask: int | None = None, from_end: bool = False) -> Column:
    """``chars_to_mask`` characters from either end; all without a number."""
    n = F.length(c)
    k = n if chars_to_mask is None else F.least(n, F.lit(max(0, chars_to_mask)))
    hidden = F.repeat(F.lit(masking_char), k.cast("int"))
    return F.concat(F.left(c, n - k), hidden) if from_end else F.concat(hidden, F.right(c, n - k))
