"""Structured-log jobs (G1-G4, P11): path redaction, level filter, record shaping.

Records of a known schema are redacted by one nested ``struct`` expression built
from the schema on the driver.  Records of unknown shape are walked as variants,
so undeclared and null fields survive; keys come out in the variant's (sorted) order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Redaction rules and level tables of the logger.
CENSOR = "[REDACTED]"
ANY_DEPTH = ("buffer", "imageBase64", "password", "token")   # redacted at any depth
TOP_LEVEL_ONLY = ("image", "base64", "file")                  # redacted at the top level only
EXACT_PATHS = ("req.headers.authorization",)
LEVEL_RANK = {"error": 0, "warn": 1, "log": 2, "debug": 3, "verbose": 4}
LEVEL_LABEL = {"error": "error", "warn": "warn", "log": "info", "debug": "debug", "verbose": "trace"}
DEFAULT_LEVEL = "log"
DEFAULT_CONTEXT = "Application"


def _redact(c: Column, dtype: T.DataType, path: tuple[str, ...]) -> Column:
    if isinstance(dtype, T.ArrayType):
        # elements sit one level deeper: only the any-depth rules reach inside arrays
        return F.transform(c, lambda e: _redact(e, dtype.elementType, path + ("[]",)))
    if isinstance(dtype, T.MapType):
        v = dtype.valueType
        censor = F.lit(CENSOR) if isinstance(v, T.StringType) else F.lit(None).cast(v)
        return F.transform_values(c, lambda k, x: F.when(k.isin(*ANY_DEPTH) & x.isNotNull(), censor)
                                  .otherwise(_redact(x, v, path + ("{}",))))
    if not isinstance(dtype, T.StructType):
        return c
    fields = []
    for f in dtype.fields:
        p = path + (f.name,)
        hit = (f.name in ANY_DEPTH or (len(p) == 1 and f.name in TOP_LEVEL_ONLY)
               or ".".join(p) in EXACT_PATHS)
        if hit:
            fields.append(F.when(c[f.name].isNotNull(), F.lit(CENSOR)).alias(f.name))
        else:
            fields.append(_redact(c[f.name], f.dataType, p).alias(f.name))
    return F.when(c.isNotNull(), F.struct(*fields))


def redact(c: Column, schema: T.StructType) -> Column:
    """G1: the record with every matching path replaced by the censor text."""
    return _redact(c, schema, ())


# Canonical JSON text (compact, as a variant is written out) is matched as text.  Escaped backslashes and quotes are one
# control character each meanwhile (canonical text has none), so that every quote left begins or ends a string: one right
# after "{" or "," begins a key or an element, a closing one is followed by ",", ":" or a bracket.
_ESCAPES = (("\\\\", "\x01"), ('\\"', "\x02"))
_NAMES = "|".join(ANY_DEPTH)
_SECRET_SCALAR = rf'([{{,]"(?:{_NAMES})":)(?:"[^"]*+"|[-0-9tf][^,}}\]]*+)'
_SECRET_NESTED = rf'[{{,]"(?:{_NAMES})":[\[{{]'
_TOKEN = r'"[^"]*+"|[{}\[\]]|[^"{}\[\]]++'
_NEAR_TOP = r'[{,]"(?:' + "|".join((*TOP_LEVEL_ONLY, *dict.fromkeys(p.split(".")[0] for p in EXACT_PATHS))) + r')":'


def _near_top(v: Column, path: tuple[str, ...] = ()) -> Column:
    """A variant with the top-level names and the exact paths replaced: as many levels as the longest path has."""
    names, deeper = set(TOP_LEVEL_ONLY if path == () else ()), set()
    for exact in (tuple(p.split(".")) for p in EXACT_PATHS):
        if exact[:len(path)] == path:
            (names if len(exact) == len(path) + 1 else deeper).add(exact[len(path)])

    def member(k: Column, x: Column) -> Column:
        out = F.when(k.isin(*sorted(names)) & ~F.is_variant_null(x), F.parse_json(F.lit(f'"{CENSOR}"')))
        for d in sorted(deeper):
            out = out.when(k == d, _near_top(x, (*path, d)))
        return out.otherwise(x)

    rebuilt = F.to_variant_object(F.transform_values(F.try_variant_get(v, "$", "map<string,variant>"), member))
    return F.coalesce(rebuilt, v)


def _without_nested(text: Column) -> Column:
    """Canonical JSON with every object or array under a secret name replaced, at any depth: one pass over its brackets
    that keeps the depth and, inside a secret value, the depth at which it began; then the tokens outside are joined."""
    names = [f'"{n}"' for n in ANY_DEPTH]

    def bracket(tokens: Column, t: Column, i: Column) -> Column:
        secret = (F.get(tokens, i - 1) == ":") & F.get(tokens, i - 2).isin(*names)
        return F.when(t.isin("{", "["), F.struct(F.lit(1).alias("by"), F.coalesce(secret, F.lit(False)).alias("secret"), i.alias("at"))) \
                .when(t.isin("}", "]"), F.struct(F.lit(-1).alias("by"), F.lit(False).alias("secret"), i.alias("at")))

    def step(s: Column, e: Column) -> Column:
        starts = e["secret"] & (s["since"] < 0)
        ends = (e["by"] < 0) & (s["since"] == s["depth"] - 1)
        return F.struct((s["depth"] + e["by"]).alias("depth"), F.when(starts, s["depth"]).when(ends, -1).otherwise(s["since"]).alias("since"),
                        F.when(starts | ends, F.concat(s["cuts"], F.array(e["at"]))).otherwise(s["cuts"]).alias("cuts"))

    def joined(tokens: Column, cuts: Column) -> Column:
        """``cuts``: first and last token of each hidden value, in turn."""
        def piece(j: Column) -> Column:
            start = F.when(j == 0, 0).otherwise(F.get(cuts, 2 * j - 1) + 1)
            shown = F.array_join(F.slice(tokens, start + 1, F.coalesce(F.get(cuts, 2 * j), F.size(tokens)) - start), "")
            return F.when(2 * j < F.size(cuts), F.concat(shown, F.lit(f'"{CENSOR}"'))).otherwise(shown)

        return F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.size(cuts) / 2).cast("int")), piece), "")

    def whole(tokens: Column) -> Column:
        brackets = F.filter(F.transform(tokens, lambda t, i: bracket(tokens, t, i)), lambda e: e.isNotNull())
        start = F.struct(F.lit(0).alias("depth"), F.lit(-1).alias("since"), F.array().cast("array<int>").alias("cuts"))
        cuts = F.aggregate(brackets, start, step, lambda s: s["cuts"])
        return F.transform(F.array(cuts), lambda c: joined(tokens, c))[0]

    return F.transform(F.array(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))), whole)[0]


def redact_json(text: Column, schema: T.StructType | None = None) -> Column:
    """G1 over JSON text at any depth, serialised compactly.  With a schema only its fields are kept, in its
    order; without one every field is.  Null secrets stay null; text that is no JSON stays as it is.

    Only records that hold a name of the top level or of an exact path are walked, and only those with an object or
    array under a secret name are taken apart into tokens; the rest is one replacement in the text."""
    if schema is not None:
        return F.to_json(redact(F.from_json(text, schema), schema))

    def top(v: Column) -> Column:
        return F.transform(F.array(F.to_json(v)), lambda c: F.when(c.rlike(_NEAR_TOP), F.to_json(_near_top(v))).otherwise(c))[0]

    canonical = F.transform(F.array(F.try_parse_json(text)), top)[0]
    for escape, mark in _ESCAPES:
        canonical = F.replace(canonical, F.lit(escape), F.lit(mark))
    scalar = F.regexp_replace(canonical, _SECRET_SCALAR, f'$1"{CENSOR}"')
    out = F.transform(F.array(scalar), lambda c: F.when(c.rlike(_SECRET_NESTED), _without_nested(c)).otherwise(c))[0]
    for escape, mark in reversed(_ESCAPES):
        out = F.replace(out, F.lit(mark), F.lit(escape))
    return F.coalesce(out, text)


def level_rank(level: Column) -> Column:
    m = F.create_map(*[x for k, v in LEVEL_RANK.items() for x in (F.lit(k), F.lit(v))])
    return m[level]


def level_filter(df: DataFrame, level: str, threshold: str) -> DataFrame:
    """Keep records whose level ranks at or below the threshold; an
    unknown threshold means ``log``."""
    t = LEVEL_RANK.get(threshold, LEVEL_RANK[DEFAULT_LEVEL])
    return df.filter(level_rank(F.col(level)) <= F.lit(t))


def level_label(level: Column) -> Column:
    """Logger level -> upper-cased sink label (log -> INFO, verbose -> TRACE)."""
    m = F.create_map(*[x for k, v in LEVEL_LABEL.items() for x in (F.lit(k), F.lit(v))])
    return F.upper(F.coalesce(m[level], F.lit(LEVEL_LABEL[DEFAULT_LEVEL])))


def shape(level: Column, context: Column, message: Column, trace: Column) -> list[Column]:
    """Label, context (default ``Application``), message text and the record's fields as JSON.

    An object (or array) message gives its fields, which win over ``context`` and ``trace``, and a fixed
    text (``Error payload`` for errors, ``Object payload`` otherwise); any other message is the text itself.
    A trace belongs to errors only and is left out when missing."""
    v = F.try_parse_json(message)
    items = F.try_variant_get(v, "$", "array<variant>")
    own = F.coalesce(F.try_variant_get(v, "$", "map<string,variant>"),
                     F.map_from_entries(F.transform(items, lambda x, i: F.struct(i.cast("string"), x))))
    ctx = F.coalesce(F.nullif(context, F.lit("")), F.lit(DEFAULT_CONTEXT))

    base = F.map_from_arrays(F.array(F.lit("context"), F.lit("trace")), F.array(ctx, F.when(level == "error", trace)))
    base = F.transform_values(F.map_filter(base, lambda k, x: x.isNotNull()),
                              lambda k, x: F.try_variant_get(F.to_variant_object(F.array(x)), "$[0]", "variant"))
    none = F.map_from_entries(F.array().cast("array<struct<key:string,value:variant>>"))
    own = F.coalesce(own, none)
    fields = F.map_concat(F.map_filter(base, lambda k, x: ~F.array_contains(F.map_keys(own), k)), own)
    is_object = F.try_variant_get(v, "$", "map<string,variant>").isNotNull() | items.isNotNull()
    msg = (F.when(~is_object, message).when(level == "error", F.lit("Error payload"))
           .otherwise(F.lit("Object payload")))
    return [level_label(level).alias("level_label"), ctx.alias("context"), msg.alias("msg"),
            F.to_json(F.to_variant_object(fields)).alias("fields_json")]
