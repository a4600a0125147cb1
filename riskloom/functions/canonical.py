"""JSON texts as column expressions, byte for byte as Python's json module writes them with sorted keys: the texts that digests are taken of."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Short escapes of JSON strings.
SHORT = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\f": "\\f", "\b": "\\b"}
#: Separators of items and of keys; the compact form has no blanks.
COMPACT, SPACED = (",", ":"), (", ", ": ")


def string(text: Column) -> Column:
    """A JSON string in ASCII: what lies outside is escaped as UTF-16 units; null for a null."""

    def unit(n: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))

    def escaped(c: Column) -> Column:
        n = F.ascii(c)
        high = n - 0x10000
        out = F.when(n < 0x10000, unit(n)).otherwise(F.concat(unit(F.lit(0xD800) + F.shiftright(high, 10)), unit(F.lit(0xDC00) + high.bitwiseAND(0x3FF))))
        for raw, short in reversed(SHORT.items()):
            out = F.when(c == raw, F.lit(short)).otherwise(out)
        return F.when(c.rlike(r'^[ !#-\[\]-~]$'), c).otherwise(out)

    plain = text.rlike(r'^[ !#-\[\]-~]*$')
    inside = F.when(plain, text).otherwise(F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), escaped), ""))
    return F.coalesce(F.concat(F.lit('"'), inside, F.lit('"')), F.lit("null"))


def items(rendered: Column, form: tuple[str, str] = COMPACT) -> Column:
    """A JSON list of an array of JSON texts."""
    return F.concat(F.lit("["), F.array_join(rendered, form[0]), F.lit("]"))


def members(fields: dict[str, Column], form: tuple[str, str] = COMPACT) -> Column:
    """A JSON object of fixed keys and JSON texts."""
    parts = [F.concat(string(F.lit(k)), F.lit(form[1]), fields[k]) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(form[0], *parts), F.lit("}"))


def mapping(pairs: Column, form: tuple[str, str] = COMPACT) -> Column:
    """A JSON object of a map of strings; a null map is an empty one."""
    sorted_ = F.array_sort(F.map_entries(F.coalesce(pairs, F.create_map().cast("map<string,string>"))))
    return F.concat(F.lit("{"), F.array_join(F.transform(sorted_, lambda e: F.concat(string(e["key"]), F.lit(form[1]), string(e["value"]))), form[0]), F.lit("}"))


#: Where a payload takes up its predecessor's hash; a JSON text never holds it.
HASH = "\0"


def audit_payload(timestamp: Column, tenant: Column, actor: Column, action: Column, details: Column) -> Column:
    """The text that an audit entry's hash is taken of, after its predecessor's; that stands in it once more."""
    return members({"timestamp": string(timestamp), "tenant": string(tenant), "actor": string(actor), "action": string(action), "details": mapping(details), "prev_hash": F.lit(f'"{HASH}"')})
