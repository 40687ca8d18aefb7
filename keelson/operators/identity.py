"""What makes two sightings the same asset."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keelson.functions import dims


def _hex4(n: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(n), 4, "0")))


def escaped(c: Column) -> Column:
    """The inside of a JSON string in ASCII, as is usual for identifiers."""
    for raw, to in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        c = F.replace(c, F.lit(raw), F.lit(to))

    def ascii_only(ch: Column) -> Column:
        n = F.ascii(ch)
        low = n - 0x10000
        pair = F.concat(_hex4(F.lit(0xD800) + F.shiftright(low, 10)), _hex4(F.lit(0xDC00) + low.bitwiseAND(F.lit(0x3FF))))
        return F.when(n < 128, ch).when(n > 0xFFFF, pair).otherwise(_hex4(n))

    return F.array_join(F.transform(F.split(c, ""), ascii_only), "")


def json_text(c: Column, plain: bool = False) -> Column:
    """c as a JSON string; null is null. plain: nothing in it needs escapes."""
    return F.coalesce(F.concat(F.lit('"'), c if plain else escaped(c), F.lit('"')), F.lit("null"))


def significant(parameters: Column, plain: bool = False) -> Column:
    """The parameters that enter identity as JSON pairs, by name, without those that are null."""
    values = [F.try_element_at(parameters, F.lit(k)) for k in dims.SIGNIFICANT]
    return F.concat_ws(",", *[F.concat(F.lit(f'["{k}","'), v if plain else escaped(v), F.lit('"]')) for k, v in zip(dims.SIGNIFICANT, values)])


def canonical_key(target: Column, kind: Column, name: Column, parameters: Column) -> Column:
    """The key as compact JSON: target, kind, name, and the significant parameters that aren't null, by name.

    Hardly any key needs escapes, and only those that do pay for them: one test tells, over all of the values.
    """
    said = F.concat_ws("", target, kind, name, *[F.try_element_at(parameters, F.lit(k)) for k in dims.SIGNIFICANT])

    def key(plain: bool) -> Column:
        return F.concat(F.lit("["), F.concat_ws(",", *[json_text(c, plain) for c in (target, kind, name)]), F.lit(",["), significant(parameters, plain), F.lit("]]"))

    return F.when(said.rlike(r"[^ !#-\[\]-~]"), key(False)).otherwise(key(True))


def bom_ref(target: Column, kind: Column, name: Column, parameters: Column) -> Column:
    return F.substring(F.sha2(canonical_key(target, kind, name, parameters), 256), 1, 16)


def describe(location: Column) -> Column:
    """Where a location is, in words."""
    place = F.coalesce(F.nullif(location["path"], F.lit("")), F.lit("<unknown>"))
    spot = F.when(location["line"].isNotNull(), F.concat(F.lit(":"), location["line"].cast("string"))).when(location["byte_offset"].isNotNull(), F.concat(F.lit("@0x"), F.lower(F.hex(location["byte_offset"])))).otherwise("")
    layer = F.when(F.coalesce(location["layer_digest"], F.lit("")) != "", F.concat(F.lit(" (layer "), F.substring(location["layer_digest"], 1, 19), F.lit(")"))).otherwise("")
    return F.when(F.coalesce(location["endpoint"], F.lit("")) != "", location["endpoint"]).otherwise(F.concat(place, spot, layer))
