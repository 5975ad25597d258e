"""Payload validation rules (V1-V11) as column expressions.

Each rule returns the violation message or NULL; a payload's violations are the
non-null messages in property order, then rule order.  The reference declares
these rules on its DTOs (the messages below are the validator library's default
texts) but never registers a validation pipe; here they run as one bulk job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Default message texts of the validation rules used by the DTOs.
MSG_IS_STRING = "{p} must be a string"
MSG_NOT_EMPTY = "{p} should not be empty"
MSG_MIN_LENGTH = "{p} must be longer than or equal to {n} characters"
MSG_MAX_LENGTH = "{p} must be shorter than or equal to {n} characters"
MSG_IS_INT = "{p} must be an integer number"
MSG_IS_UUID = "{p} must be a UUID"
MSG_IS_DATE = "{p} must be a Date instance"
MSG_MIN = "{p} must not be less than {n}"
MSG_MAX = "{p} must not be greater than {n}"

UUID_PATTERN = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
INT_PATTERN = r"^-?[0-9]+$"


def _msg(cond: Column, template: str, prop: str, n=None) -> Column:
    return F.when(cond, F.lit(template.format(p=prop, n=n)))


def is_string(c: Column, prop: str) -> Column:
    """V2 on text input: only a missing value fails."""
    return _msg(c.isNull(), MSG_IS_STRING, prop)


def not_empty(c: Column, prop: str) -> Column:
    """V3."""
    return _msg(c.isNull() | (c == ""), MSG_NOT_EMPTY, prop)


def min_length(c: Column, n: int, prop: str) -> Column:
    """V4 (NULL fails, as a non-string would)."""
    return _msg(c.isNull() | (F.length(c) < n), MSG_MIN_LENGTH, prop, n)


def max_length(c: Column, n: int, prop: str) -> Column:
    return _msg(c.isNull() | (F.length(c) > n), MSG_MAX_LENGTH, prop, n)


def is_int(c: Column, prop: str) -> Column:
    """V6: the value must be an integral number (text form checked by pattern)."""
    return _msg(c.isNull() | ~c.cast("string").rlike(INT_PATTERN), MSG_IS_INT, prop)


def is_uuid(c: Column, prop: str) -> Column:
    """V1."""
    return _msg(c.isNull() | ~c.rlike(UUID_PATTERN), MSG_IS_UUID, prop)


def is_date(c: Column, prop: str) -> Column:
    """V8 with coercion: text that does not parse as a date/time fails."""
    return _msg(F.try_to_timestamp(c).isNull(), MSG_IS_DATE, prop)


def in_range(c: Column, lo: int | None, hi: int | None, prop: str) -> list[Column]:
    """V7: ``Min``/``Max``."""
    out = []
    if lo is not None:
        out.append(_msg(c < lo, MSG_MIN, prop, lo))
    if hi is not None:
        out.append(_msg(c > hi, MSG_MAX, prop, hi))
    return out


def optional(c: Column, rules: list[Column]) -> list[Column]:
    """V9: optional fields skip all their rules when NULL/absent."""
    return [F.when(c.isNotNull(), r) for r in rules]


def violations(rules: list[Column]) -> Column:
    """Non-null messages, in the given order."""
    return F.filter(F.array(*rules), lambda x: x.isNotNull())


def create_book_rules(title: Column, isbn: Column, year: Column) -> list[Column]:
    """``book.create``: title string, not empty, >= 3; isbn optional, 10..13 characters (V5);
    publishedYear optional integer."""
    return [
        is_string(title, "title"), not_empty(title, "title"), min_length(title, 3, "title"),
        *optional(isbn, [min_length(isbn, 10, "isbn"), max_length(isbn, 13, "isbn"), is_string(isbn, "isbn")]),
        *optional(year, [is_int(year, "publishedYear")]),
    ]


def create_author_rules(first: Column, last: Column, birth: Column) -> list[Column]:
    """``author.create``: names string, not empty, >= 3; birthDate a date and, as
    declared, required (V10: no optional mark although the field is typed optional)."""
    return [
        is_string(first, "firstName"), not_empty(first, "firstName"), min_length(first, 3, "firstName"),
        is_string(last, "lastName"), not_empty(last, "lastName"), min_length(last, 3, "lastName"),
        is_date(birth, "birthDate"),
    ]


def validate(df: DataFrame, rules: list[Column], keep: list[str]) -> DataFrame:
    """Per row: ``violations`` (array), ``message`` (V11: joined with '; ') and ``is_valid``."""
    v = violations(rules)
    return df.select(*keep, v.alias("violations")).select(
        *keep, "violations", F.array_join("violations", "; ").alias("message"),
        (F.size("violations") == 0).alias("is_valid"))


def summary(validated: DataFrame) -> DataFrame:
    """Rows per distinct violation message ('' = clean)."""
    return validated.groupBy("message").agg(F.count(F.lit(1)).alias("n_rows"))


# --- the rule sets of all topics over JSON payloads --------------------------
def _name(first: bool = True) -> list[tuple]:
    return [("string",), *([("not_empty",)] if first else []), ("min_length", 3)]


_OPT, _NUMBER = ("optional",), ("number",)
# Per topic the properties in order and the rules declared on each. "optional" skips the others when
# the value is absent or null; "number" marks a value turned into a number first.
RULES_BY_TOPIC = {
    "author.create": {"firstName": _name(), "lastName": _name(), "birthDate": [("date",)]},
    "author.update": {"id": [("uuid",)], "firstName": [_OPT, *_name(False)], "lastName": [_OPT, *_name(False)],
                      "birthDate": [_OPT, ("date",)]},
    "author.delete": {"id": [("uuid",)]},
    "author.get": {"id": [("uuid",)]},
    "author.getAll": {"page": [_NUMBER, ("int",), ("min", 1)], "limit": [_NUMBER, ("int",), ("min", 1), ("max", 100)],
                      "firstName": [_OPT, *_name(False)], "lastName": [_OPT, *_name(False)],
                      "birthDate": [_OPT, ("date",)]},
    "book.create": {"title": _name(), "isbn": [_OPT, ("string",), ("min_length", 10), ("max_length", 13)],
                    "publishedYear": [_OPT, ("int",)]},
    "book.update": {"id": [("uuid",)], "title": [_OPT, *_name(False)],
                    "isbn": [_OPT, ("string",), ("min_length", 10), ("max_length", 13)],
                    "publishedYear": [_OPT, ("int",)]},
    "book.delete": {"id": [("string",), ("not_empty",)]},
    "book.get": {"id": [("uuid",)]},
    "book.getAll": {"page": [_OPT, ("int",), ("min", 1)], "limit": [_OPT, ("int",), ("min", 1), ("max", 100)],
                    "title": [_OPT, *_name(False)], "isbn": [_OPT, *_name(False)], "publishedYear": [_OPT, ("int",)]},
    "authorBook.assign": {"authorId": [("uuid",), ("not_empty",)], "bookId": [("uuid",), ("not_empty",)]},
    "authorBook.unassign": {"id": [("uuid",), ("not_empty",)]},
}


def _json_rules(message: Column, prop: str, rules: list[tuple]) -> list[Column]:
    """The messages of one property's rules, judged by JSON type: a number is no string, text is no
    number unless the property is turned into one first."""
    v = F.try_variant_get(message, f"$.{prop}", "variant")
    kind = F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    absent, is_text = kind == "VOID", kind == "STRING"
    text = F.when(is_text, F.try_variant_get(v, "$", "string"))
    number = F.when(~kind.isin("STRING", "BOOLEAN", "VOID"), F.try_variant_get(v, "$", "double"))
    if _NUMBER in rules:  # as JavaScript's Number(): '' is 0, true is 1; null and absent values stay
        number = F.when(is_text, F.when(text == "", F.lit(0.0)).otherwise(text.try_cast("double"))) \
            .when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("double")).otherwise(number)

    def ok(cond: Column) -> Column:
        return F.coalesce(cond, F.lit(False))

    def judge(rule: str, n: int | None = None) -> Column:
        passed, template = {
            "string": (is_text, MSG_IS_STRING),
            "not_empty": (~absent & ~ok(text == ""), MSG_NOT_EMPTY),
            "min_length": (ok(F.length(text) >= F.lit(n)), MSG_MIN_LENGTH),
            "max_length": (ok(F.length(text) <= F.lit(n)), MSG_MAX_LENGTH),
            "int": (ok(number == F.floor(number)), MSG_IS_INT),
            "min": (ok(number >= F.lit(n)), MSG_MIN),
            "max": (ok(number <= F.lit(n)), MSG_MAX),
            "uuid": (ok(text.rlike(UUID_PATTERN)), MSG_IS_UUID),
            "date": (F.try_to_timestamp(text).isNotNull() | number.isNotNull(), MSG_IS_DATE),
        }[rule]
        return _msg(~passed, template, prop, n)

    judged = [judge(*r) for r in rules if r not in (_OPT, _NUMBER)]
    return [F.when(~absent, c) for c in judged] if _OPT in rules else judged


def topic_violations(topic: Column, message: Column) -> Column:
    """The violations of a message (a parsed JSON variant) by its topic's rule set, as an array of texts; an unknown
    topic has none."""
    out = F.array().cast("array<string>")
    for name, props in RULES_BY_TOPIC.items():
        out = F.when(topic == name, violations([m for p, rules in props.items() for m in _json_rules(message, p, rules)])) \
            .otherwise(out)
    return out
