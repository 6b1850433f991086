"""Replacement values, from a key's hash and its ordinal in the document."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskwright import fixed_values as fixed


def _words(words: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _integer_part(dividend: Column, divisor: int) -> Column:
    return F.floor(dividend / divisor).cast("bigint")


def name(bucket: Column, ordinal: Column) -> Column:
    first = F.get(_words(fixed.FIRST_NAMES), (bucket % len(fixed.FIRST_NAMES)).cast("int"))
    last = F.get(_words(fixed.LAST_NAMES), (_integer_part(bucket, 11) % len(fixed.LAST_NAMES)).cast("int"))
    return F.concat_ws(" ", first, last)


def email(bucket: Column, ordinal: Column) -> Column:
    return F.format_string("contact%03d@example.com", ordinal)


def phone(bucket: Column, ordinal: Column) -> Column:
    area = 70000 + bucket % 29999
    subscriber = 10000 + (_integer_part(bucket, 97) + ordinal * 7919) % 90000
    return F.format_string("+91 %05d %05d", area, subscriber)


def company(bucket: Column, ordinal: Column) -> Column:
    return F.format_string("Example Entity %03d Limited", ordinal)


def address(bucket: Column, ordinal: Column) -> Column:
    return F.format_string(
        "%d Example Avenue, Sample City - 400%03d, India", ordinal + 100, ordinal % 1000
    )


def ssn(bucket: Column, ordinal: Column) -> Column:
    return F.format_string("900-%02d-%04d", ordinal % 100, ordinal + 1000)


def card(bucket: Column, ordinal: Column) -> Column:
    """Sixteen digits that pass the check-digit test; the ordinal's last digit gives way to it."""
    body = F.substring(F.format_string(f"{fixed.CARD_PREFIX}%04d", ordinal % 10000), 1, 15)
    # The digit that completes the number is the one of ten that the test accepts.
    number = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(body, d.cast("string"))),
        lambda n: F.call_function("luhn_check", n),
    )[0]
    return F.regexp_replace(number, r"(\d{4})(?=\d)", "$1 ")


def birth_date(bucket: Column, ordinal: Column) -> Column:
    return F.format_string("01/01/%d", ordinal % 30 + 1980)


def ip(bucket: Column, ordinal: Column) -> Column:
    return F.format_string("203.0.113.%d", ordinal % 250 + 1)


MAKERS = {
    "name": name, "email": email, "phone": phone, "company": company, "address": address,
    "ssn": ssn, "card": card, "dob": birth_date, "ip": ip,
}


def fake(pii_type: Column, bucket: Column, ordinal: Column) -> Column:
    value = F
    wide = ordinal.cast("bigint")
    for kind, make in MAKERS.items():
        value = value.when(pii_type == kind, make(bucket, wide))
    unknown = F.raise_error(F.concat(F.lit("unknown type of personal data: "), pii_type))
    return value.otherwise(unknown)
