"""Strings that hold several values: one value per row, with its position.

The string is split on quote characters. Odd pieces are literal, even pieces are split on the
delimiters; a fold over the pieces keeps order and reassembles values whose quote was doubled.
Everything is built-in Spark SQL, so nothing leaves the JVM.

Rules
- Delimiters: ``; , | /`` and white space, any mixture; runs of them make no values.
- A quote opens a value only where a value may begin; elsewhere it is an ordinary character.
- Inside a value quoted in one kind, the other kind and all delimiters are ordinary; the same
  kind doubled stands for one quote.
- A quote that is never closed holds the rest of the field.
- One pair of brackets around the whole field is dropped.
- Null, empty and blank fields give an empty array; values that are blank give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DELIMITERS = r"[;,|/\s]+"
_ENDS_OPEN = r"(^|[;,|/\s])$"  # an unquoted run after which a value may begin
_STATE = "struct<quote:string,closed:boolean,buf:string,out:array<string>>"


def _plain(run: Column) -> Column:
    """Values of an unquoted run."""
    return F.filter(F.split(run, DELIMITERS), lambda x: x != "")


def _literal(buf: Column) -> Column:
    value = F.regexp_replace(buf, r"^\s+|\s+$", "")
    return F.when(value != "", F.array(value)).otherwise(F.array().cast("array<string>"))


def _step(acc: Column, piece: Column) -> Column:
    def state(quote, closed, buf, out):
        return F.struct(quote.alias("quote"), closed.alias("closed"), buf.alias("buf"), out.alias("out")).cast(_STATE)

    no, yes, none = F.lit(False), F.lit(True), F.lit("")
    is_quote = piece.isin("'", '"')
    inside = acc["quote"] != ""
    return (
        # outside of quotes
        F.when(~inside & is_quote & acc["buf"].rlike(_ENDS_OPEN), state(piece, no, none, F.concat(acc["out"], _plain(acc["buf"]))))
        .when(~inside, state(none, no, F.concat(acc["buf"], piece), acc["out"]))
        # the quote was closed: the same again was a doubled one
        .when(acc["closed"] & (piece == acc["quote"]), state(acc["quote"], no, F.concat(acc["buf"], piece), acc["out"]))
        .when(acc["closed"] & is_quote, state(piece, no, none, F.concat(acc["out"], _literal(acc["buf"]))))
        .when(acc["closed"], state(none, no, piece, F.concat(acc["out"], _literal(acc["buf"]))))
        # inside of quotes
        .when(piece == acc["quote"], state(acc["quote"], yes, acc["buf"], acc["out"]))
        .otherwise(state(acc["quote"], no, F.concat(acc["buf"], piece), acc["out"]))
    )


def _finish(acc: Column) -> Column:
    return F.concat(acc["out"], F.when(acc["quote"] == "", _plain(acc["buf"])).otherwise(_literal(acc["buf"])))


def split_packed(col: Column | str) -> Column:
    """The values of a packed string as ``array<string>``; see the module's rules."""
    text = F.regexp_replace(F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")), r"^\s+|\s+$", "")
    text = F.when(text.rlike(r"(?s)^(\[.*\]|\{.*\}|\(.*\))$"), F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(text)
    start = F.struct(F.lit("").alias("quote"), F.lit(False).alias("closed"), F.lit("").alias("buf"), F.array().cast("array<string>").alias("out")).cast(_STATE)
    folded = F.aggregate(F.split(text, r"""(?=['"])|(?<=['"])"""), start, _step, _finish)
    # Without any quote there is one even piece, and the fold comes down to its split.
    return F.when(text.rlike("""['"]"""), folded).otherwise(_plain(text))


def explode_packed(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """One row per value: ``keys``, field_name, pos (from 1), item. Fields without values give no row."""
    packed = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("packed")) for f in fields])).alias("_p")
    long = df.select(*keys, packed).select(*keys, "_p.field_name", split_packed(F.col("_p.packed")).alias("_items"))
    return long.select(*keys, "field_name", F.posexplode("_items").alias("_at", "item")).select(*keys, "field_name", (F.col("_at") + 1).cast("int").alias("pos"), "item")
