"""Dynamic JSON values as Spark structs, with sort keys and coercions.

A value is a struct: present (the key exists, even if null), rank (type order; null for JSON null and for missing), b,
n, s (text of a string, JSON text of an array or object), len (of arrays and objects), repr (canonical text, by which
values are equal: 5 and 5.0 differ).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DDL = "struct<present:boolean,rank:int,b:boolean,n:double,s:string,len:int,repr:string>"
NULL, BOOL, NUMBER, STRING, ARRAY, OBJECT = range(6)
_NUMBER = r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"


def missing() -> Column:
    return F.lit(None).cast(DDL)


def quote(text: Column) -> Column:
    """Text as a JSON string."""
    j = F.to_json(F.array(text))
    return F.substring(j, F.lit(2), F.length(j) - 2)


def _unquote(json_string: Column) -> Column:
    return F.get_json_object(F.concat(F.lit('{"v":'), json_string, F.lit("}")), "$.v")


def json_value(text: Column) -> Column:
    """The value of JSON text; null text is a missing value (a null struct), text that is no JSON a string of itself."""
    t = F.trim(text)
    first = F.substring(t, 1, 1)
    nested = first.isin("[", "{") & F.try_parse_json(t).isNotNull()
    rank = (
        F.when(t == "null", F.lit(None).cast("int"))
        .when(t.isin("true", "false"), BOOL)
        .when(F.rlike(t, F.lit(_NUMBER)), NUMBER)
        .when(nested & (first == "["), ARRAY)
        .when(nested, OBJECT)
        .otherwise(STRING)
    )
    string = F.when(first == '"', F.coalesce(_unquote(t), t)).otherwise(t)
    size = F.when(rank == ARRAY, F.json_array_length(t)).when(rank == OBJECT, F.size(F.json_object_keys(t)))
    number = t.try_cast("double")
    shown = (
        F.when(rank == STRING, quote(string))
        .when((rank == NUMBER) & ~F.rlike(t, F.lit(r"^-?[0-9]+$")), number.cast("string"))
        .when(rank.isin(ARRAY, OBJECT), F.coalesce(_unquote(t), t))
        .otherwise(t)
    )
    value = F.struct(
        F.lit(True).alias("present"),
        rank.alias("rank"),
        F.when(rank == BOOL, t == "true").alias("b"),
        F.when(rank == NUMBER, number).alias("n"),
        F.when(rank == STRING, string).when(rank.isin(ARRAY, OBJECT), t).alias("s"),
        size.cast("int").alias("len"),
        shown.alias("repr"),
    )
    return F.when(text.isNotNull(), value)


def scalar_value(col: Column, kind: str) -> Column:
    """A value made of a plain column; null is JSON null. kind is string, number (double), int or bool."""
    text = {
        "string": quote(col.cast("string")),
        "number": col.cast("double").cast("string"),
        "int": col.cast("long").cast("string"),
        "bool": col.cast("string"),
    }[kind]
    rank = {"string": STRING, "number": NUMBER, "int": NUMBER, "bool": BOOL}[kind]
    none = F.lit(None)
    return F.struct(
        F.lit(True).alias("present"),
        F.when(col.isNotNull(), rank).alias("rank"),
        (col if kind == "bool" else none.cast("boolean")).alias("b"),
        (col.cast("double") if rank == NUMBER else none.cast("double")).alias("n"),
        (col.cast("string") if kind == "string" else none.cast("string")).alias("s"),
        none.cast("int").alias("len"),
        F.when(col.isNull(), "null").otherwise(text).alias("repr"),
    )


def is_present(v: Column) -> Column:
    return v.isNotNull() & F.coalesce(v["present"], F.lit(False))


def display(v: Column) -> Column:
    """A scalar's text; JSON text of arrays and objects; empty for null and missing."""
    return F.coalesce(F.when(v["rank"] == NUMBER, v["repr"]).when(v["rank"] == BOOL, v["b"].cast("string")).when(v["rank"].isNotNull(), v["s"]), F.lit(""))


def scalar_texts(v: Column) -> Column:
    """Texts of all scalars in a value: of itself, or of the elements and object values within, at any depth."""
    # keys are matched with their colon, so that they are taken out whole
    token = r'"(?:[^"\\]|\\.)*"(?:\s*:)?|(?<![\w."])(?:-?[0-9][0-9.eE+-]*|true|false)(?![\w"])'
    found = F.filter(F.regexp_extract_all(v["s"], F.lit(token), F.lit(0)), lambda x: ~F.endswith(x, F.lit(":")))
    inside = F.transform(found, lambda x: F.when(F.startswith(x, F.lit('"')), F.coalesce(_unquote(x), x)).otherwise(x))
    return F.when(v["rank"].isin(ARRAY, OBJECT), inside).when(v["rank"].isNotNull(), F.array(display(v))).otherwise(F.array().cast("array<string>"))


def text_key(v: Column) -> Column:
    """Sort key of the row sort: by type, then value; arrays and objects by their JSON text; null for null and missing."""
    return F.when(v["rank"].isNotNull(), F.struct(v["rank"].alias("r"), v["b"].alias("b"), v["n"].alias("n"), v["s"].alias("s")))


def length_key(v: Column, null_rank: bool = False) -> Column:
    """Sort key of views: as text_key, but arrays and objects by length. null_rank: JSON null sorts below all."""
    s = F.when(v["rank"] == STRING, v["s"])
    rank = F.when(is_present(v), F.coalesce(v["rank"], F.lit(NULL))) if null_rank else v["rank"]
    return F.when(rank.isNotNull(), F.struct(rank.alias("r"), v["b"].alias("b"), v["n"].alias("n"), s.alias("s"), v["len"].alias("l")))


def order(key: Column, desc: bool = False, nulls_last: bool = False) -> Column:
    """Sort order of a key. Descending turns the placement of nulls around as well."""
    if desc:
        return key.desc_nulls_first() if nulls_last else key.desc_nulls_last()
    return key.asc_nulls_last() if nulls_last else key.asc_nulls_first()


def read_type(declared: Column) -> Column:
    """Field type that a stored value_type stands for; anything unknown is a string."""
    t = F.lower(declared)
    return (
        F.when(t.isin("number", "int", "integer", "float", "double"), "number")
        .when(t.isin("bool", "boolean", "checkbox"), "bool")
        .when(t.isin("date", "datetime"), "date")
        .when(t.isin("json", "object", "array"), "json")
        .otherwise("string")
    )


COERCION_ERROR = "bases.coercion.invalid_value"


def coerce(v: Column, kind: str, strict: bool = True) -> Column:
    """A value as text of the type, or null if it can't be; with strict=True an error instead.

    string: scalars, null is empty. number: trimmed decimal number, true and false as 1 and 0, none that isn't finite.
    bool: true/yes/1, false/no/0. date: exactly YYYY-MM-DD by form. json: as it is.
    """
    text = display(v)
    scalar = v["rank"].isNull() | ~v["rank"].isin(ARRAY, OBJECT)
    low = F.lower(F.trim(text))
    if kind == "json":
        return v["repr"]
    if kind == "string":
        out = F.when(scalar, text)
    elif kind == "number":
        number = F.when(v["rank"] == BOOL, v["b"].cast("int").cast("double")).when(scalar & F.rlike(low, F.lit(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?$")), low.try_cast("double"))
        out = F.when(~F.isnan(number) & (F.abs(number) < F.lit(float("inf"))), number.cast("string"))
    elif kind == "bool":
        out = F.when(scalar & low.isin("true", "yes", "1", "1.0"), "true").when(scalar & low.isin("false", "no", "0", "0.0"), "false")
    elif kind == "date":
        out = F.when((v["rank"] == STRING) & F.rlike(text, F.lit(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$")), text)
    else:
        raise ValueError(f"unknown type {kind!r}")
    return F.coalesce(out, F.raise_error(F.lit(COERCION_ERROR)).cast("string")) if strict else out
