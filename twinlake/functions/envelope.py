"""Reply envelopes as columns (E1-E10): success/error structs, code choice,
message normalisation and inbound reply decoding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import iso_timestamp, js_or

# Exception class -> HTTP status, and the default texts.
STATUS_BY_CLASS = {
    "UnauthorizedException": 401,
    "NotFoundException": 404,
    "ConflictException": 409,
    "BadRequestException": 400,
    "ForbiddenException": 403,
}
INTERNAL_ERROR = 500
DEFAULT_MESSAGE = "Internal server error"
INBOUND_DEFAULT_STATUS = 400
TIMEOUT_STATUS = 503
TIMEOUT_MESSAGE = "Service temporarily unavailable"

JSON_OPTS = {"ignoreNullFields": "false"}


def status_by_class(class_name: Column) -> Column:
    m = F.create_map(*[x for k, v in STATUS_BY_CLASS.items() for x in (F.lit(k), F.lit(v))])
    return m[class_name]


def error_code(get_status: Column, status: Column, status_code: Column, class_name: Column) -> Column:
    """getStatus() || status || statusCode || by class || 500 (JS ``||``: 0 and '' skipped)."""
    return F.coalesce(js_or(get_status, status, status_code), status_by_class(class_name),
                      F.lit(INTERNAL_ERROR)).cast("int")


def normalise_message(message_list: Column, message_text: Column) -> Column:
    """Array -> joined with '; '; text kept; nothing -> default text."""
    return F.coalesce(F.when(F.size(message_list) > 0, F.array_join(message_list, "; ")),
                      F.nullif(message_text, F.lit("")), F.lit(DEFAULT_MESSAGE))


def normalise_error_message(response: Column, message: Column) -> Column:
    """E4 over an error's JSON ``response`` and its own text: ``response.message`` when present (a list
    joined with '; ', an object as JSON, else its text, also the empty one), else ``message || default``."""
    v = F.try_parse_json(response)
    own = F.try_variant_get(v, "$.message", "variant")
    listed = F.try_variant_get(own, "$", "array<string>")
    return (F.when(listed.isNotNull(), F.array_join(listed, "; "))
            .when(own.isNotNull() & ~F.is_variant_null(own), F.get_json_object(response, "$.message"))
            .otherwise(F.coalesce(F.nullif(message, F.lit("")), F.lit(DEFAULT_MESSAGE))))


def json_value(text: Column, key: str) -> Column:
    """A top-level member as JSON text: strings keep their quotes; absent or null gives NULL."""
    own = F.try_variant_get(F.try_parse_json(text), f"$.{key}", "variant")
    return F.when(F.schema_of_variant(own) == "STRING", F.to_json(own)).otherwise(F.get_json_object(text, f"$.{key}"))


def merge_meta(ts: Column, meta: Column) -> Column:
    """``{timestamp, ...meta}`` as JSON text; a field of ``meta`` wins, keys in sorted order."""
    own = F.coalesce(F.from_json(meta, "map<string,variant>"),
                     F.map_from_entries(F.array().cast("array<struct<key:string,value:variant>>")))
    stamp = F.map_from_arrays(F.array(F.lit("timestamp")), F.array(
        F.try_variant_get(F.to_variant_object(F.array(iso_timestamp(ts))), "$[0]", "variant")))
    stamp = F.map_filter(stamp, lambda k, x: ~F.array_contains(F.map_keys(own), k))
    return F.to_json(F.to_variant_object(F.map_concat(stamp, own)))


def success(data_json: Column, ts: Column) -> Column:
    """``{success: true, data, meta: {timestamp}}``; a missing result becomes ``true``."""
    return F.struct(F.lit(True).alias("success"), F.coalesce(data_json, F.lit("true")).alias("data"),
                    F.lit(None).cast("struct<message:string,code:int,details:string>").alias("error"),
                    F.struct(iso_timestamp(ts).alias("timestamp")).alias("meta"))


def error(message: Column, code: Column, ts: Column, details: Column | None = None) -> Column:
    """``{success: false, error: {message, code, details}, meta: {timestamp}}``; details are JSON text."""
    details = F.lit(None).cast("string") if details is None else details
    return F.struct(F.lit(False).alias("success"), F.lit(None).cast("string").alias("data"),
                    F.struct(message.alias("message"), code.cast("int").alias("code"),
                             details.alias("details")).alias("error"),
                    F.struct(iso_timestamp(ts).alias("timestamp")).alias("meta"))


def paginated_meta(total: Column, page: Column, limit: Column) -> Column:
    """``meta.pagination`` of the (unused in the reference) paginated helper."""
    return F.struct(total.alias("total"), page.alias("page"), limit.alias("limit"),
                    F.ceil(total / limit).cast("bigint").alias("totalPages"))


def _truthy(v: Column, path: str) -> Column:
    """Whether a value inside a variant counts as true in ``||``: by its type, so the text "0" does."""
    x, s = F.try_variant_get(v, path, "variant"), F.try_variant_get(v, path, "string")
    kind = F.schema_of_variant(x)
    return (F.coalesce(kind, F.lit("VOID")) != "VOID") & ~(
        F.coalesce(((kind == "STRING") & (s == "")) | ((kind == "BOOLEAN") & (s == "false"))
                   | (~kind.isin("STRING", "BOOLEAN") & (s.try_cast("double") == 0)), F.lit(False)))


def decode_inbound(text: Column) -> Column:
    """Normalise a reply received from another service.

    Returns ``struct(ok, code, message, data)``: on ``success = false`` the code
    is ``error.code || statusCode || 400`` and any *text* code becomes 400; the
    message ``error.message || message || default``.  On success the data is
    ``data`` when present, else the whole object (``inbound_details`` has an error's details).
    """
    v = F.try_parse_json(text)
    succ = F.try_variant_get(v, "$.success", "boolean")
    code_v = F.coalesce(*[F.when(_truthy(v, p), F.try_variant_get(v, p, "variant")) for p in ("$.error.code", "$.statusCode")])
    is_text = F.schema_of_variant(code_v) == "STRING"
    code = (F.when(code_v.isNull() | is_text, F.lit(INBOUND_DEFAULT_STATUS))
            .otherwise(F.coalesce(F.try_variant_get(code_v, "$", "int"), F.lit(INBOUND_DEFAULT_STATUS))))
    msg = F.coalesce(*[F.when(_truthy(v, p), F.try_variant_get(v, p, "string")) for p in ("$.error.message", "$.message")],
                     F.lit(DEFAULT_MESSAGE))
    has_data = F.coalesce(F.array_contains(F.json_object_keys(text), "data"), F.lit(False))
    data = json_value(text, "data")
    failed = succ.isNotNull() & ~succ
    return F.struct(
        (~failed).alias("ok"),
        F.when(failed, code).alias("code"),
        F.when(failed, msg).alias("message"),
        F.when(~failed, F.when(has_data, data).otherwise(text)).alias("data"))


def inbound_details(text: Column) -> Column:
    """The fields of a failed reply's ``error.details`` as JSON text; NULL when there are none."""
    v = F.try_parse_json(text)
    failed = F.coalesce(~F.try_variant_get(v, "$.success", "boolean"), F.lit(False))
    given = F.try_variant_get(v, "$.error.details", "map<string,variant>")
    return F.when(failed & (F.size(given) > 0), F.to_json(F.to_variant_object(given)))


def normalise_result(result: Column, ts: Column) -> Column:
    """A handler's result (JSON text) as the reply it produces.

    * an object that already has ``success`` passes through unchanged, its error too (E7);
    * an object with both ``data`` and ``meta`` is unwrapped: its data becomes the
      reply data and its meta fields are spread into the reply meta (E2);
    * no result (``undefined``) becomes ``data: true``;
    * anything else is the reply data as is.

    Returns ``struct(kind, success, data, meta, error, timestamp)`` with data, meta and error as JSON text;
    the meta of all but a wrapped result holds the timestamp.
    """
    v = F.try_parse_json(result)
    wrapped = F.try_variant_get(v, "$.success", "variant").isNotNull()
    has_dm = (F.try_variant_get(v, "$.data", "variant").isNotNull()
              & F.try_variant_get(v, "$.meta", "variant").isNotNull())
    kind = (F.when(result.isNull(), F.lit("empty")).when(wrapped, F.lit("wrapped"))
            .when(has_dm, F.lit("unwrapped")).otherwise(F.lit("plain")))
    data = (F.when(result.isNull(), F.lit("true"))
            .when(wrapped | has_dm, json_value(result, "data")).otherwise(result))
    success = F.when(wrapped, F.try_variant_get(v, "$.success", "boolean")).otherwise(F.lit(True))
    wrapped = F.coalesce(wrapped, F.lit(False))
    meta = (F.when(wrapped, F.get_json_object(result, "$.meta"))
            .otherwise(merge_meta(ts, F.when(has_dm, F.get_json_object(result, "$.meta")))))
    err = F.when(wrapped, json_value(result, "error"))
    return F.struct(kind.alias("kind"), success.alias("success"), data.alias("data"), meta.alias("meta"), err.alias("error"),
                    iso_timestamp(ts).alias("timestamp"))


ERROR_RESPONSE_RESERVED = ("message", "statusCode", "error")


def error_details(response: Column) -> Column:
    """E5: the error response minus ``message``, ``statusCode`` and ``error``;
    NULL (absent) when nothing is left.  Values keep their JSON types."""
    m = F.from_json(response, "map<string,variant>")
    rest = F.map_filter(m, lambda k, _: ~k.isin(*ERROR_RESPONSE_RESERVED))
    return F.when(F.size(rest) > 0, F.to_json(rest))
