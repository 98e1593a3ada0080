"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

A text becomes tokens ``[\\p{L}\\p{N}]+``, of which a number with its separators (3.5, 1,000,
12:30) and a run of names are one each; numbers, units after a number, and names
(capitalised inside a sentence) become typed placeholders. Windows of ``k`` template
tokens of the benchmark are hash-joined with every window of each document, so that any
passage that holds a window of an item meets it. Candidates are then compared at every
position along neighbouring diagonals (a value of more or fewer words moves what follows
it), and the slots (the values behind the placeholders) must map consistently from item
to document: that admits re-parameterised questions but not texts that only share a form.

Defined cases: null or empty texts hold no window; windows of fewer than two plain
tokens are not evidence; an item without a window is never found; rows that share an id
but not the text are judged each, and a pair of ids is reported once, by its best;
a null id, of a document or an item, is kept as null; other columns are ignored. An
empty table on either side gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.common import written

#: Unit words that are a placeholder after a number.
UNITS = "mm cm m km inch inches ft feet mile miles mg g kg t lb lbs oz ml l litre litres liter liters s sec second seconds min minute minutes h hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents apples items pieces degrees km2 m2 kmh mph"
NUMBER, NAME, UNIT = "0", "0name", "0unit"
#: Marks of the private use area, blanks if a text has them: within a whole number, within a run of names, around names.
IN_NUMBER, IN_NAMES, BEGIN, END = "\ue000", "\ue001", "\ue002", "\ue003"
SPLIT = rf"[^\p{{L}}\p{{N}}{IN_NUMBER}{IN_NAMES}]+"
#: A broadcast of benchmark windows or candidate ids needs no more rows than this; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
#: ... and no more bytes, as JSON, than this.
BROADCAST_BYTES = 256 << 20


def _marked(text: Column) -> Column:
    """The text with whole numbers and runs of names held together, and names between marks."""
    t = F.translate(F.coalesce(text, F.lit("")), IN_NUMBER + IN_NAMES + BEGIN + END, "    ")
    t = F.regexp_replace(t, r"(?<=\p{N})[.,:/'\u2019\u00a0\u202f](?=\p{N})", IN_NUMBER)
    t = F.regexp_replace(t, r"(?<=[\p{L}\p{N},;:] )\p{Lu}\p{L}*", f"{BEGIN}$0{END}")
    return F.regexp_replace(t, f"{END} {BEGIN}", IN_NAMES)


def _split(text: Column) -> Column:
    return F.filter(F.split(text, SPLIT), lambda t: t != "")


def tokens(text: Column) -> Column:
    return _split(F.translate(_marked(text), BEGIN + END, ""))


def template(text: Column) -> Column:
    """Template tokens, one for each of ``tokens``."""
    t = F.regexp_replace(_marked(text), rf"\p{{N}}+(?:{IN_NUMBER}\p{{N}}+)*", NUMBER)
    t = F.regexp_replace(t, f"{BEGIN}[^{END}]*{END}", NAME)
    t = F.regexp_replace(t, rf"(?i)(?<=(?<![\p{{L}}\p{{N}}])0 )(?:{'|'.join(UNITS.split())})(?![\p{{L}}\p{{N}}])", UNIT)
    return F.transform(_split(t), lambda x: F.lower(x))


def slot(token: Column) -> Column:
    return token.startswith(NUMBER)


def _hash(template_column: str, at: Column, k: int) -> Column:
    return F.xxhash64(F.slice(template_column, at, F.lit(k)))


def _starts(column: str, k: int) -> Column:
    n = F.size(column) - k + 1
    return F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def _bounded(df: DataFrame) -> DataFrame:
    """Broadcast only what has been counted, in rows and in bytes."""
    rows, size = df.limit(BROADCAST_ROWS + 1).agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))), F.lit(0))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


def _function(slots: Column) -> Column:
    return F.size(F.array_distinct(F.transform(slots, lambda x: x["a"]))) == F.size(slots)


def _added(done: Column, line: Column) -> Column:
    """The evidence with a line's, if the slots of both are one function from item to document."""
    slots = F.array_union(done["slots"], line["slots"])
    more = F.struct(F.array_union(done["at"], line["at"]).alias("at"), slots.alias("slots"))
    return F.when(_function(slots), more).otherwise(done)


def leaks(docs: DataFrame, benchmark: DataFrame, k: int = 5, coverage: float = 0.5, windows: int = 9, drift: int = 5) -> DataFrame:
    """(doc_id, item_id, n_windows, item_windows, n_slots): a row per contaminated pair.

    A pair counts if ``coverage`` of the item's windows or ``windows`` of them match and the
    slots under them map item values to document values as a function. At least three
    windows must match (or all of the item's, if it has fewer). The windows are those of a
    diagonal, nearest first with those of diagonals at most ``drift`` tokens from it whose
    slots go with what is there.
    """
    items = benchmark.select("item_id", F.xxhash64("text").alias("item"), tokens(F.col("text")).alias("item_tokens"), template(F.col("text")).alias("tpl"))
    grams = items.select("item_id", "item", "item_tokens", "tpl", F.explode(_starts("tpl", k)).alias("ipos"))
    piece = F.slice("tpl", F.col("ipos"), F.lit(k))
    grams = grams.where(F.size(F.filter(piece, lambda t: ~slot(t))) >= 2).select(
        "item_id", "item", "ipos", _hash("tpl", F.col("ipos"), k).alias("gram"), F.slice("item_tokens", F.col("ipos"), F.lit(k)).alias("item_raw"), piece.alias("form")
    )
    grams = written(grams)
    sizes = grams.groupBy(F.col("item_id").alias("_item_id"), F.col("item").alias("_item")).agg(F.countDistinct("ipos").alias("item_windows"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("doc"), "text")
    pair = ("doc_id", "doc", "item_id", "item")  # texts that share an id are judged each
    at = rows.select("doc_id", template(F.col("text")).alias("tpl"))
    formed = at.select("doc_id", F.explode(F.transform(_starts("tpl", k), lambda i: _hash("tpl", i, k))).alias("gram"))
    found = written(formed.join(_bounded(grams.select("gram").distinct()), "gram", "left_semi").select("doc_id").distinct())
    found = _bounded(found.withColumnRenamed("doc_id", "found_id"))
    hit = rows.join(found, F.col("doc_id").eqNullSafe(F.col("found_id")), "left_semi")
    every = hit.select("doc_id", "doc", tokens(F.col("text")).alias("raw"), template(F.col("text")).alias("tpl"))
    every = every.select("doc_id", "doc", "raw", "tpl", F.explode(_starts("tpl", k)).alias("dpos"))
    every = every.select("doc_id", "doc", "dpos", _hash("tpl", F.col("dpos"), k).alias("gram"), F.slice("raw", F.col("dpos"), F.lit(k)).alias("doc_raw"))
    pairs = every.join(_bounded(grams), "gram").withColumn(
        "slots",
        F.transform(
            F.filter(F.arrays_zip("form", "item_raw", "doc_raw"), lambda x: slot(x["form"])),
            lambda x: F.struct(F.lower(x["item_raw"]).alias("a"), F.lower(x["doc_raw"]).alias("b")),
        ),
    )
    lines = pairs.groupBy(*pair, (F.col("dpos") - F.col("ipos")).alias("diagonal")).agg(
        F.collect_set("ipos").alias("at"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots")
    )
    lines = lines.where(_function(F.col("slots"))).withColumn("away", F.explode(F.sequence(F.lit(-drift), F.lit(drift))))
    near = lines.groupBy(*pair, (F.col("diagonal") + F.col("away")).alias("diagonal")).agg(
        F.sort_array(F.collect_list(F.struct(F.abs("away").alias("far"), "away", "at", "slots"))).alias("lines")
    )
    near = near.where(F.col("lines")[0]["far"] == 0)
    own = F.struct(F.col("lines")[0]["at"].alias("at"), F.col("lines")[0]["slots"].alias("slots"))
    near = near.select(*pair, F.aggregate(F.slice("lines", F.lit(2), F.size("lines")), own, _added).alias("all"))
    near = near.select(*pair, F.size("all.at").cast("long").alias("n_windows"), F.size("all.slots").cast("long").alias("n_slots"))
    n, of = F.col("n_windows"), F.col("item_windows")
    near = near.join(_bounded(sizes), F.col("item_id").eqNullSafe(F.col("_item_id")) & (F.col("item") == F.col("_item"))).where((n >= F.least(F.lit(3), of)) & ((n >= coverage * of) | (n >= windows)))
    return near.groupBy("doc_id", "item_id").agg(
        F.max("n_windows").alias("n_windows"), F.max("item_windows").alias("item_windows"), F.max("n_slots").alias("n_slots")
    )
