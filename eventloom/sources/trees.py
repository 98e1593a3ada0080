"""Pages as rows of elements, numbered so that ancestors are intervals; nearest boxes, table grids with roles, definition lists.

Python only cuts a page into numbered elements, a page at a time; what is asked of them is joins
on page and number, running counts and aggregates.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from eventloom.functions.dates import heading_year
from eventloom.functions.scalars import bound, normal_url
from eventloom.sources.pages import ASSET, resolved

#: No address without such an ending in it can be that of a document or picture, so that others are not resolved.
NAMED = r"(?i)\.(?:pdf|jpe?g|png|gif|webp)"

#: How far up a nearest box is looked for, and how deep elements nest at most (deeper ones become children of the last).
LEVELS, DEEPEST = 8, 512
#: Elements sent on at once, and pages and characters taken up at once: they bound a task's memory, not the result.
MANY, PAGES, CHARACTERS = 20_000, 64, 4_000_000
#: How many different tags a task remembers.
KNOWN = 4096
NODE = "pre int, last int, depth int, parent int, tag string, attrs map<string,string>, begin int, end int, above array<int>, row int, table int"
# Fixed values of the HTML standard: elements without content, elements whose content is text, and what an opening tag ends.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"thead", "tbody", "tr", "td", "th"}, "body": {"head"}}
CLOSES |= {t: {"p"} for t in "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()}
#: Elements that an implied end does not pass.
KEEPS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "tfoot": {"table"}}
_TAG = r"[A-Za-z][^\s/>]*", r"[^>\"']*+(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*+)*+"
TOKEN = re.compile(rf"<!---?>|<!--.*?(?:--!?>|\Z)|<[!?][^>]*>|</?{_TAG[0]}{_TAG[1]}>", re.S)
PARTS = re.compile(rf"<(/?)({_TAG[0]})({_TAG[1]})>", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
# The columns of a table of events by their headings, and how long a heading may be.
ROLES = {"date": "月日|日付|日時|開催日|期日|日程", "title": "イベント|行事|名称|内容|催", "place": "場所|会場|開催地"}
#: A span as Spark casts it to an int, and the white space that ``compact`` makes one blank.
SPAN, BLANKS = re.compile(r"[\x00-\x20\x7f]*([+-]?[0-9]+)[\x00-\x20\x7f]*"), re.compile("[ \\t\\n\\x0b\\f\\r\\u3000\\xa0]+")
HEADER_DATE, HEADER_TITLE, HEADER_LENGTH = "月日|日付|日時|開催日|期日|日程", "イベント|行事|名称|内容", 25


_OPEN, _VOID, _RAW, _END = range(4)
_known: dict[str, tuple] = {}


def _tag(token: str) -> tuple:
    """(kind, name, attrs, closes, keeps) of a tag, of comments and declarations nothing; short tags that were seen are kept, up to KNOWN."""
    m = PARTS.match(token)
    found: tuple = ()
    if m:
        name, attrs = m[2].lower(), {}
        for key, *said in ATTRIBUTE.findall(m[3]) if m[3] and not m[1] else ():
            value = said[0] or said[1] or said[2]
            attrs.setdefault(key.lower(), entities.unescape(value) if "&" in value else value)
        kind = _END if m[1] else _RAW if name in RAW else _VOID if name in VOID else _OPEN
        found = (kind, name, list(attrs.items()), CLOSES.get(name), KEEPS.get(name))
    if len(token) < 64:
        if len(_known) >= KNOWN:
            _known.clear()
        _known[token] = found
    return found


def _elements(page: str, levels: int = LEVELS) -> tuple[list[list], str]:
    """The elements of a page in order, [pre, last, depth, parent, tag, attrs, begin, end, above, row, table], and its text."""
    out: list[list] = []
    stack: list[int] = []
    names: list[str] = []  # of the elements on the stack
    text: list[str] = []
    size = at = 0
    tokens = TOKEN.finditer(page)

    def end(depth: int) -> None:
        del names[depth:]
        while len(stack) > depth:
            node = out[stack.pop()]
            node[1], node[7] = len(out) - 1, size

    while True:
        m = next(tokens, None)
        begin = m.start() if m else len(page)
        if begin > at:
            part = page[at:begin]
            if "&" in part:
                part = entities.unescape(part)
            text.append(part)
            size += len(part)
        if not m:
            break
        at, token = m.end(), m[0]
        found = _known.get(token)
        if found is None:
            found = _tag(token)
        if not found:
            continue
        kind, tag, attrs, closes, keeps = found
        if kind == _END:
            depth = len(names) - 1
            while depth >= 0 and names[depth] != tag:
                depth -= 1
            if depth >= 0:
                end(depth)
            continue
        if closes:
            for i in range(len(stack) - 1, -1, -1):
                if names[i] in closes:
                    end(i)
                elif keeps is None or names[i] in keeps:
                    break
        parent = row = table = None
        n = len(out)
        if stack:
            parent = stack[-1]
            around = out[parent]
            row, table = parent if around[4] == "tr" else around[9], parent if around[4] == "table" else around[10]
        out.append([n, n, len(stack), parent, tag, attrs, size, size, stack[: -levels - 1 : -1] if levels else (), row, table])
        if kind == _OPEN:
            if len(stack) < DEEPEST:
                stack.append(n)
                names.append(tag)
        elif kind == _RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])|\Z", re.I).search(page, at)
            if tag in ("title", "textarea"):
                part = entities.unescape(page[at : close.start()])
                text.append(part)
                size += len(part)
            out[-1][7] = size
            at = close.start()
            rest = re.compile(r"[^>]*>").match(page, at)
            at = rest.end() if rest else len(page)
            tokens = TOKEN.finditer(page, at)
    end(0)
    return out, "".join(text)


def elements(pages: DataFrame, id_: str, html: str, cut: Callable[[DataFrame], DataFrame] = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """((id, NODE), (id, text)): the elements of every page and its whole text; a null page has none.

    ``pre`` numbers elements in order from 0, those of a subtree are pre..last; begin..end is its
    part of the text; ``above`` are its nearest LEVELS ancestors, the parent first; ``row`` and
    ``table`` the nearest tr and table around it. Rows of one id must be one. ``cut`` may write the
    elements and read them again, so that pages are not cut into elements for each use.
    """
    own = pages.select(F.col(id_).alias("id"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    kind = own.schema["id"].dataType.simpleString()
    fields = _fields()

    def cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _cut(batches):
            held: list[tuple] = []
            for i, (rows, text) in enumerate(found):
                held += [(i, *r, None) for r in rows]
                held.append((i, *[None] * len(fields), text))  # the last row has the page's text
            at, *columns, texts = zip(*held, strict=True)
            ids = batch.column("id").take(pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)), pa.array(texts, pa.string())], ["id", *(n for n, _ in fields), "text"])

    both = cut(own.mapInArrow(cut_rows, f"id {kind}, {NODE}, text string"))
    return both.where("pre is not null").drop("text"), both.where("pre is null").select("id", "text")


def trees(pages: DataFrame, html: str) -> DataFrame:
    """The pages' other columns with ``nodes``, the elements of ``elements`` in order, and ``text``, the whole text, in place of the html.

    An element is at the place of its number, so that what asks for ancestors reads them there, without a join.
    """
    rest = [c for c in pages.columns if c != html]
    own = pages.select(*rest, F.coalesce(F.col(html), F.lit("")).alias("html"))
    kinds = "".join(f"`{c}` {own.schema[c].dataType.simpleString()}, " for c in rest)
    fields = _fields()

    def cut_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _cut(batches):
            columns = list(zip(*(r for rows, _ in found for r in rows), strict=True)) or [[]] * len(fields)
            flat = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])
            ends = pa.array(np.cumsum([0, *(len(rows) for rows, _ in found)]), pa.int32())
            texts = pa.array([text for _, text in found], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.ListArray.from_arrays(ends, flat), texts], [*rest, "nodes", "text"])

    node = ", ".join(f"{n}: {t}" for n, t in (f.split(" ", 1) for f in NODE.split(", ")))
    return own.mapInArrow(cut_pages, f"{kinds}nodes array<struct<{node}>>, text string")


def _fields() -> list[tuple[str, pa.DataType]]:
    types = {"int": pa.int32(), "string": pa.string(), "map": pa.map_(pa.string(), pa.string()), "array<int>": pa.list_(pa.int32())}
    return [(n, types[t]) for n, t in (f.split(" ", 1) for f in NODE.replace("map<string,string>", "map").split(", "))]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[list[list], str]]]]:
    """Some pages at a time with the elements and the text of each."""
    for batch in batches:
        first, found, n, size = 0, [], 0, 0
        for i in range(len(batch)):
            if i % PAGES == 0:
                pages = batch.column("html").slice(i, PAGES).to_pylist()
            found.append(_elements(pages[i % PAGES]))
            n, size = n + len(found[-1][0]), size + len(pages[i % PAGES])
            if n > MANY or size > CHARACTERS or i == len(batch) - 1:
                yield batch.slice(first, i + 1 - first), found
                first, found, n, size = i + 1, [], 0, 0


def compact(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[\s　\x{00a0}]+", " "))


def part_of(text: Column, begin: Column, end: Column) -> Column:
    return F.substr(text, begin + 1, end - begin)


@F.arrow_udf(ArrayType(IntegerType()))
def _running(flags: pa.Array) -> pa.Array:
    """The running count of the true ones of each list."""
    ends = flags.offsets.to_numpy()
    upto = np.cumsum(flags.values.to_numpy(zero_copy_only=False)[: ends[-1]], dtype=np.int32)
    before = np.concatenate([np.zeros(1, np.int32), upto])[ends[:-1]]
    counted = upto[ends[0] :] - np.repeat(before, np.diff(ends))
    return pa.ListArray.from_arrays(pa.array(ends - ends[0], pa.int32()), pa.array(counted, pa.int32()))


def _ways(pages: DataFrame, targets: Callable[[Column], Column], counted: Callable[[Column], Column], keep: Callable[[Column], list[Column]], named: Callable[[Column], list[Column]]) -> DataFrame:
    """(id, target, ``keep`` of the target, boxes): the ancestors of each target in order, with ``n`` and ``named``, none beyond main."""
    own = pages.where(F.exists("nodes", targets)).select("id", "nodes", _running(F.transform("nodes", lambda x: F.coalesce(counted(x), F.lit(False)))).alias("upto"))
    nodes, upto = F.col("nodes"), F.col("upto")

    def box(b: Column, level: Column) -> Column:
        at = F.get(nodes, b)
        return F.struct(level.alias("level"), b.alias("box"), at["tag"].alias("tag"), at["begin"].alias("begin"), at["end"].alias("end"), (F.get(upto, at["last"]) - F.get(upto, b)).alias("n"), *named(at))

    ways = F.transform(F.filter(nodes, targets), lambda t: F.struct(t["pre"].alias("target"), *keep(t), F.transform(t["above"], box).alias("boxes")))
    found = own.select("id", F.explode(ways).alias("w")).select("id", "w.*")
    # a main element ends the way up: what lies above it is no box
    main = F.array_position(F.transform("boxes", lambda x: x["tag"]), "main").cast("int")
    return found.withColumn("boxes", F.when(main > 0, F.slice("boxes", F.lit(1), main)).otherwise(F.col("boxes")))


def _box(x: Column) -> Column:
    return ~x["tag"].isin("html", "body")


def nearest_in(pages: DataFrame, targets: Callable[[Column], Column], counted: Callable[[Column], Column], good: Callable[[Column], Column], keep: Callable[[Column], list[Column]] = lambda t: [], named: Callable[[Column], list[Column]] = lambda b: []) -> DataFrame:
    """``nearest_box`` over (id, nodes) of ``trees``: no row leaves its page, so that nothing is shuffled.

    (id, target, box, tag, level) and what ``keep`` takes from the target and ``named`` from the box.
    """
    ways = _ways(pages, targets, counted, keep, named)
    best = ways.withColumn("b", F.get(F.filter("boxes", lambda x: _box(x) & good(x)), F.lit(0))).where("b is not null")
    more = [c for c in best.select("b.*").columns if c not in ("level", "box", "tag", "begin", "end", "n")]
    return best.select("id", "target", "b.box", "b.tag", "b.level", *(c for c in ways.columns if c not in ("id", "target", "boxes")), *(f"b.{c}" for c in more))


def nearest_box(nodes: DataFrame, texts: DataFrame, targets: Column, counted: Column, good: Column, field: str = "", fallback: bool = False) -> DataFrame:
    """(id, target, box, tag, level): for each target element its nearest ancestor (not html or body, none beyond main) that is good.

    ``good`` may use ``n``, how many elements that meet ``counted`` lie in the ancestor, and ``has``,
    whether its text has the pattern ``field``. With ``fallback``, the outermost ancestor that has the
    field serves if none is good. Counts are differences of a running count, so no pair of elements
    of a page is compared; an ancestor's text is read once however many targets it has. The elements of
    a page meet in one row.
    """
    marked = nodes.select("id", F.struct("pre", "last", "tag", "begin", "end", "above", F.coalesce(targets, F.lit(False)).alias("_target"), F.coalesce(counted, F.lit(False)).alias("_counted")).alias("x"))
    pages = marked.groupBy("id").agg(F.sort_array(F.collect_list("x")).alias("nodes"))
    ways = _ways(pages, lambda x: x["_target"], lambda x: x["_counted"], lambda t: [], lambda b: [])
    asked = ways.select("id", "target", F.inline("boxes"))
    if field:
        boxes = asked.select("id", "box", "begin", "end").distinct().join(texts, "id")
        asked = asked.join(boxes.select("id", "box", part_of(F.col("text"), F.col("begin"), F.col("end")).rlike(field).alias("has")), ["id", "box"])
    else:
        asked = asked.withColumn("has", F.lit(True))
    judged = asked.where(~F.col("tag").isin("html", "body")).withColumn("_good", good)
    pick = F.struct("level", "box", "tag")
    best = judged.groupBy("id", "target").agg(F.min(F.when(F.col("_good") & F.col("has"), pick)).alias("_near"), F.max(F.when(F.col("has"), pick)).alias("_far"))
    found = F.coalesce("_near", "_far") if fallback else F.col("_near")
    return best.select("id", "target", found.alias("_b")).where("_b is not null").select("id", "target", "_b.box", "_b.tag", "_b.level")


class _Places:
    """A fold over a table's cells in order that carries, per column, the cell that reaches down and for how many rows."""

    def __init__(self) -> None:
        self.tr, self.row, self.col, self.carried, self.fresh = None, -1, 0, {}, {}

    def add(self, tr: int, across: int, down: int, cell: tuple) -> list[tuple]:
        """(row, col, *cell) of what the cell covers in its row, after what reaches down into the row if the row begins with it."""
        out = []
        if tr != self.tr:
            if self.carried or self.fresh:
                self.carried = {c: (n - 1, v) for c, (n, v) in (self.carried | self.fresh).items() if n > 1}
            self.tr, self.row, self.col, self.fresh = tr, self.row + 1, 0, {}
            if self.carried:
                out = [(self.row, c, *v) for c, (_, v) in sorted(self.carried.items())]
        while self.col in self.carried:
            self.col += 1
        for _ in range(across):
            if self.col in self.carried:
                break
            out.append((self.row, self.col, *cell))
            if down > 1:
                self.fresh[self.col] = (down, cell)
            self.col += 1
        return out


def grid(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, table, row, col, tag, text): every cell of every table at each place it covers, rows and columns from 0.

    Spans are resolved by a fold over a table's rows in order that carries, per column, the cell
    that reaches down and for how many rows; only that is held, never a table.
    """
    cells = nodes.where(F.col("tag").isin("td", "th") & F.col("row").isNotNull() & F.col("table").isNotNull() & (F.col("row") > F.col("table")))
    span = lambda n, most: F.least(F.greatest(F.coalesce(F.try_element_at("attrs", F.lit(n)).try_cast("int"), F.lit(1)), F.lit(1)), F.lit(most))
    rows = cells.join(texts, "id").select("id", "table", F.col("row").alias("tr"), "pre", "tag", span("colspan", 1000).alias("across"), span("rowspan", 65534).alias("down"), compact(part_of(F.col("text"), F.col("begin"), F.col("end"))).alias("text"))
    kind = nodes.schema["id"].dataType.simpleString()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, places = None, _Places()
        for batch in batches:
            ids, out = [], []
            for i, x in enumerate(batch.select(["table", "tr", "tag", "across", "down", "text"]).to_pylist()):
                now = (batch.column("id")[i].as_py(), x["table"])
                if now != table:
                    table, places = now, _Places()
                found = places.add(x["tr"], x["across"], x["down"], (x["tag"], x["text"]))
                ids += [i] * len(found)
                out += [(x["table"], *f) for f in found]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(ids, pa.int32())), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], ["id", "table", "row", "col", "tag", "text"])

    return rows.repartition("id", "table").sortWithinPartitions("id", "table", "tr", "pre").mapInArrow(fold, f"id {kind}, table int, row int, col int, tag string, text string")


def with_roles(cells: DataFrame) -> DataFrame:
    """(id, table, row, col, role, text) of the rows below each table's header; tables without one give none.

    The header is the first row that has a short date heading and a short title heading; a role is the first column
    whose heading matches, the first and second column if none does. A column may have two roles (開催日 has a word of
    titles, too); those without one are left out.
    """
    bare = F.regexp_replace("text", r"\s", "")
    short = F.char_length("text") < HEADER_LENGTH
    whole, line = Window.partitionBy("id", "table"), Window.partitionBy("id", "table", "row")
    any_ = lambda pattern: F.max(short & bare.rlike(pattern)).over(line)
    named = cells.withColumn("_both", any_(HEADER_DATE) & any_(HEADER_TITLE))
    named = named.withColumn("_head", F.min(F.when(F.col("_both"), F.col("row"))).over(whole))
    first = lambda role: F.min(F.when((F.col("row") == F.col("_head")) & bare.rlike(ROLES[role]), F.col("col"))).over(whole)
    named = named.withColumns({"_date": F.coalesce(first("date"), F.lit(0)), "_title": F.coalesce(first("title"), F.lit(1)), "_place": first("place")})
    roles = F.array_compact(F.array(*[F.when(F.col("col") == F.col(f"_{r}"), F.lit(r)) for r in ROLES]))
    return named.where("row > _head").select("id", "table", "row", "col", F.explode(roles).alias("role"), "text")


def _span(said: str | None, most: int) -> int:
    m = SPAN.fullmatch(said) if said else None
    n = int(m[1]) if m else 1
    return min(n, most) if 0 < n < 1 << 31 else 1


def tables_in(pages: DataFrame, html: str) -> DataFrame:
    """The pages' other columns, with ``table`` and ``cells``, the (row, col, tag, text) of ``grid`` in order: a row per table with a cell.

    A table never leaves its page, so that nothing is shuffled; the elements themselves are not sent on. One table is one row.
    """
    rest = [c for c in pages.columns if c != html]
    own = pages.select(*rest, F.coalesce(F.col(html), F.lit("")).alias("html"))
    kinds = "".join(f"`{c}` {own.schema[c].dataType.simpleString()}, " for c in rest)
    fields = [("row", pa.int32()), ("col", pa.int32()), ("tag", pa.string()), ("text", pa.string())]

    def placed(rows: list[list], text: str) -> Iterator[tuple[int, list[tuple]]]:
        cells = [r for r in rows if (r[4] == "td" or r[4] == "th") and r[9] is not None and r[10] is not None and r[9] > r[10]]
        cut = BLANKS.sub
        cells.sort(key=lambda r: (r[10], r[9]))
        table = None
        for r in cells:
            if r[10] != table:
                if table is not None:
                    yield table, out
                table, places, out = r[10], _Places(), []
            across = down = 1
            if r[5]:
                said = dict(r[5])
                across, down = _span(said.get("colspan"), 1000), _span(said.get("rowspan"), 65534)
            out += places.add(r[9], across, down, (r[4], cut(" ", text[r[6] : r[7]]).strip(" ")))
        if table is not None:
            yield table, out

    def batch_of(batch: pa.RecordBatch, at: list[int], tables: list[int], cells: list[list[tuple]]) -> pa.RecordBatch:
        columns = list(zip(*(c for x in cells for c in x), strict=True))
        flat = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])
        ends = pa.array(np.cumsum([0, *map(len, cells)]), pa.int32())
        taken = [batch.column(c).take(pa.array(at, pa.int32())) for c in rest]
        return pa.RecordBatch.from_arrays([*taken, pa.array(tables, pa.int32()), pa.ListArray.from_arrays(ends, flat)], [*rest, "table", "cells"])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, tables, cells, n = [], [], [], 0
            for i in range(len(batch)):
                if i % PAGES == 0:
                    pages = batch.column("html").slice(i, PAGES).to_pylist()
                for table, out in placed(*_elements(pages[i % PAGES], 0)):
                    at.append(i)
                    tables.append(table)
                    cells.append(out)
                    n += len(out)
                    if n > MANY:
                        yield batch_of(batch, at, tables, cells)
                        at, tables, cells, n = [], [], [], 0
            if at:
                yield batch_of(batch, at, tables, cells)

    return own.mapInArrow(fold, f"{kinds}table int, cells array<struct<row: int, col: int, tag: string, text: string>>")


def roles_in(tables: DataFrame) -> DataFrame:
    """``with_roles`` over rows of ``tables_in``: their other columns, row, col, role, text, without a shuffle."""
    rest = [c for c in tables.columns if c != "cells"]
    cells = F.col("cells")
    bare = lambda x: F.regexp_replace(x["text"], r"\s", "")
    row = lambda x: x["row"]
    headings = lambda pattern, more: F.transform(F.filter(cells, lambda x: more(x) & (F.char_length(x["text"]) < HEADER_LENGTH) & bare(x).rlike(pattern)), row)

    def named(head: Column) -> Column:
        first = lambda heads, role: F.array_min(F.transform(F.filter(heads, lambda h: h["t"].rlike(ROLES[role])), lambda h: h["col"]))
        heads = F.transform(F.filter(cells, lambda x: row(x) == head), lambda x: F.struct(x["col"].alias("col"), bare(x).alias("t")))
        return bound(heads, lambda h: F.struct(head.alias("head"), F.coalesce(first(h, "date"), F.lit(0)).alias("date"), F.coalesce(first(h, "title"), F.lit(1)).alias("title"), first(h, "place").alias("place")))

    def below(at: Column) -> Column:
        roles = lambda x: F.array_compact(F.array(*[F.when(x["col"] == at[r], F.struct(x["row"].alias("row"), x["col"].alias("col"), F.lit(r).alias("role"), x["text"].alias("text"))) for r in ROLES]))
        return F.flatten(F.transform(F.filter(cells, lambda x: row(x) > at["head"]), roles))

    # rows that have a date heading are few, so that titles are looked for in them alone; each step is a value that the next one reads
    dated = F.array_distinct(headings(HEADER_DATE, lambda x: F.lit(True)))
    head = lambda rows: F.array_min(headings(HEADER_TITLE, lambda x: F.array_contains(rows, row(x))))
    found = bound(dated, lambda rows: bound(head(rows), lambda h: bound(named(h), below)))
    return tables.select(*rest, F.inline(found))


def label_values(cells: DataFrame) -> DataFrame:
    """(id, table, row, label, value): the first two cells of rows that begin with a heading cell or have just two cells."""
    at = lambda i, c: F.max(F.when(F.col("col") == i, F.col(c)))
    rows = cells.groupBy("id", "table", "row").agg(F.count("*").alias("_n"), at(0, "tag").alias("_tag"), at(1, "tag").alias("_second"), at(0, "text").alias("label"), at(1, "text").alias("value"))
    return rows.where("(_tag = 'th' and _second = 'td') or (_n = 2 and _second = 'td')").select("id", "table", "row", "label", "value")


def definitions(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, label, value): every dd of a list with the dt before it."""
    own = nodes.where(F.col("tag").isin("dt", "dd")).join(texts, "id").select("id", "pre", "parent", "tag", compact(part_of(F.col("text"), F.col("begin"), F.col("end"))).alias("_text"))
    label = F.last(F.when(F.col("tag") == "dt", F.col("_text")), ignorenulls=True).over(Window.partitionBy("id", "parent").orderBy("pre"))
    return own.withColumn("label", label).where("tag = 'dd' and label is not null").select("id", "label", F.col("_text").alias("value"))


def year_contexts(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, pre, context): for every element the year of the last heading or caption before it, itself included, that names one.

    The context is struct<year, fiscal>, with nulls before the first such heading. One window over a
    page's elements in order; only headings are joined with the page's text.
    """
    heads = nodes.where(F.col("tag").isin(*HEADINGS, "caption")).select("id", "pre", "begin", "end").join(texts, "id")
    said = heads.select("id", "pre", heading_year(part_of(F.col("text"), F.col("begin"), F.col("end"))).alias("_said")).where("_said is not null")
    order = Window.partitionBy("id").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last("_said", ignorenulls=True).over(order)
    nothing = F.struct(F.lit(None).cast("int").alias("year"), F.lit(False).alias("fiscal"))
    return nodes.select("id", "pre").join(said, ["id", "pre"], "left").select("id", "pre", F.coalesce(last, nothing).alias("context"))


def dated_entries(pages: DataFrame, entries: Callable[[Column], Column]) -> DataFrame:
    """The other columns of ``trees``, pre, text and the context of ``year_contexts`` of every element that meets ``entries``, without a shuffle.

    A running count of the headings that name a year tells which of them is an element's last one.
    """
    rest = [c for c in pages.columns if c not in ("nodes", "text")]
    own = lambda x: part_of(F.col("text"), x["begin"], x["end"])
    head = lambda x: x["tag"].isin(*HEADINGS, "caption")
    said = F.transform("nodes", lambda x: F.when(head(x), bound(own(x), heading_year)))
    upto = _running(F.transform("_said", lambda x: x.isNotNull()))
    counted = pages.withColumn("_said", said).select(*rest, "nodes", "text", F.filter("_said", lambda x: x.isNotNull()).alias("_heads"), upto.alias("_upto"))
    nothing = F.struct(F.lit(None).cast("int").alias("year"), F.lit(False).alias("fiscal"))
    context = lambda x: F.coalesce(F.get("_heads", F.get("_upto", x["pre"]) - 1), nothing)
    found = F.transform(F.filter("nodes", entries), lambda x: F.struct(x["pre"].alias("pre"), own(x).alias("text"), context(x).alias("context")))
    return counted.select(*rest, F.inline(found))


def assets(nodes: DataFrame, texts: DataFrame, urls: DataFrame, most: int = 120) -> DataFrame:
    """``assets_in`` over elements and texts; ``urls`` has (id, page_url). The elements of a page meet in one row."""
    pages = nodes.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pre", "tag", F.map_entries("attrs").alias("attrs"), "begin", "end", "above"))).alias("nodes"))
    pages = pages.withColumn("nodes", F.transform("nodes", lambda x: x.withField("attrs", F.map_from_entries(x["attrs"]))))
    return assets_in(pages.join(texts, "id").join(urls, "id"), most)


def assets_in(pages: DataFrame, most: int = 120) -> DataFrame:
    """(id, url, type, label): the documents (pdf) and pictures (image) that pages link or show, each once a page.

    ``pages`` has (id, page_url, nodes, text). Addresses are resolved against the page and normalised. Links come
    first, then pictures, then the alternatives of a source's ``srcset``; the first in page order gives
    the label: a link's text, a picture's ``alt`` or else the text of the link around it, at most ``most``
    characters of it. Pages without an address have no assets. Only what is found is sent on, with its label.
    """
    nodes, nothing = F.col("nodes"), F.lit(None).cast("string")
    attr = lambda x, n: F.try_element_at(x["attrs"], F.lit(n))
    entry = lambda kind, pre, pos, raw, alt, link: F.struct(F.lit(kind).alias("kind"), pre.alias("pre"), pos.alias("pos"), raw.alias("raw"), alt.alias("alt"), link.alias("link"))
    around = lambda x: F.get(F.filter(x["above"], lambda b: F.get(nodes, b)["tag"] == "a"), F.lit(0))
    links = F.transform(F.filter(nodes, lambda x: (x["tag"] == "a") & attr(x, "href").rlike(NAMED)), lambda x: entry(0, x["pre"], F.lit(0), attr(x, "href"), nothing, x["pre"]))
    pictures = F.transform(F.filter(nodes, lambda x: (x["tag"] == "img") & attr(x, "src").rlike(NAMED)), lambda x: entry(1, x["pre"], F.lit(0), attr(x, "src"), F.nullif(attr(x, "alt"), F.lit("")), around(x)))
    listed = lambda x: F.transform(F.split(attr(x, "srcset"), ","), lambda r, i: entry(2, x["pre"], i, F.get(F.split(compact(r), " "), F.lit(0)), F.lit(""), F.lit(None).cast("int")))
    others = F.flatten(F.transform(F.filter(nodes, lambda x: (x["tag"] == "source") & attr(x, "srcset").rlike(NAMED)), listed))
    named = F.filter(F.concat(links, pictures, others), lambda x: x["raw"].rlike(NAMED))
    # a label is the alt, which may be empty, or the text of the link that is around or is the entry itself
    said = lambda x: F.trim(F.left(compact(part_of(F.col("text"), F.get(nodes, x["link"])["begin"], F.get(nodes, x["link"])["end"])), F.lit(most)))
    labelled = F.transform(named, lambda x: F.struct(*[x[c].alias(c) for c in ("kind", "pre", "pos", "raw")], F.coalesce(F.left(F.trim(x["alt"]), F.lit(most)), said(x), F.lit("")).alias("label")))
    found = pages.select("id", "page_url", F.explode(labelled).alias("e")).select("id", "page_url", "e.*")
    found = found.withColumn("url", bound(resolved(F.col("raw"), F.col("page_url")), normal_url)).where(F.col("url").rlike(ASSET))
    first = found.groupBy("id", "url").agg(F.min(F.struct("kind", "pre", "pos", "label"))["label"].alias("label"))
    kind = F.when(F.col("url").rlike(r"(?i)\.pdf(?:[?#]|$)"), "pdf").otherwise("image")
    return first.select("id", "url", kind.alias("type"), "label")
