"""Object literals of page scripts as rows: a scan that knows comments and strings, then variants. Nothing is evaluated. All in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.scalars import bound

#: The tokens of a literal: comments, strings in three quotes, numbers, names, marks; white space falls between them.
TOKEN = r"""(?s)//[^\n\r]*|/\*.*?(?:\*/|\z)|"[^"\\]*+(?:\\.[^"\\]*+)*+"|'[^'\\]*+(?:\\.[^'\\]*+)*+'|`[^`\\]*+(?:\\.[^`\\]*+)*+`|-?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|[\p{L}_$][\p{L}\p{N}_$]*|[^\s]"""


def _string(token: Column) -> Column:
    """A string in single or back quotes as one in double quotes."""
    inner = F.substr(token, F.lit(2), F.char_length(token) - 2)
    inner = F.regexp_replace(inner, r"\\(['`$])", "$1")
    inner = F.regexp_replace(inner, r"\\\r?\n", "")
    inner = F.regexp_replace(F.regexp_replace(F.regexp_replace(inner, "\r", r"\\r"), "\n", r"\\n"), "\t", r"\\t")
    return F.concat(F.lit('"'), F.regexp_replace(inner, r'(?<!\\)((?:\\\\)*)"', r'$1\\"'), F.lit('"'))


def object_literal(text: Column, name: str) -> Column:
    """The JSON of the object or array that a script assigns to ``name``, null if there is none or it does not end.

    Keys may be names, numbers or strings; comments and trailing commas go; undefined and NaN are
    null. A literal that holds anything else (calls, operators, ``${}``) is null when it is parsed.
    """
    start = F.regexp_instr(text, F.lit(rf"(?s)\b{name}\s*[=:]\s*[{{\[]"))
    rest = F.regexp_replace(F.substr(text, start, F.char_length(text)), rf"(?s)\A{name}\s*[=:]\s*", "")
    tokens = F.filter(F.regexp_extract_all(rest, F.lit(TOKEN), F.lit(0)), lambda t: ~t.startswith("//") & ~t.startswith("/*"))
    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(a: Column, t: Column) -> Column:
        depth = a["depth"] + F.when(t.isin("{", "["), 1).when(t.isin("}", "]"), -1).otherwise(0)
        return F.struct(depth.alias("depth"), (a["at"] + 1).alias("at"), F.when((a["end"] == 0) & (depth == 0), a["at"] + 1).otherwise(a["end"]).alias("end"))

    def written(t: Column, after: Column) -> Column:
        key = (after == ":") & t.rlike(r"\A[\p{L}\p{N}_$.-]")
        plain = F.when(t.isin("undefined", "NaN"), "null").when(t.rlike(r"\A['`]"), _string(t)).otherwise(t)
        return F.when((t == ",") & after.isin("}", "]"), "").when(key, F.concat(F.lit('"'), t, F.lit('"'))).otherwise(plain)

    def whole(tokens: Column, end: Column) -> Column:
        # each token beside the next one: an index into the tokens would look one up for each
        pairs = F.zip_with(F.slice(tokens, F.lit(1), end), F.slice(tokens, F.lit(2), end), written)
        return F.array_join(pairs, "")

    # the text is cut into tokens once, and their end is found once
    ended = lambda tokens: bound(F.aggregate(tokens, zero, step)["end"], lambda end: F.when(end > 0, whole(tokens, end)))
    return F.when(start > 0, bound(tokens, ended))


def nested_rows(rows: DataFrame, id_: str, literal: Column, levels: tuple[str, ...], value: str) -> DataFrame:
    """(id, a column per level, pos, value): the leaves of objects within objects whose innermost value is an array; one that is no JSON gives none."""
    spark = rows.sparkSession
    out = rows.select(id_, F.try_parse_json(literal).alias("_v"))
    for i, level in enumerate((*levels, "pos")):
        spread = spark.tvf.variant_explode(F.col("_v").outer())
        found = out.lateralJoin(spread)
        step = F.col("pos" if level == "pos" else "key").alias(level)
        out = found.select(id_, *levels[:i], step, F.col("value").alias("_v"))
    return out.select(id_, *levels, "pos", F.col("_v").cast("string").alias(value))
