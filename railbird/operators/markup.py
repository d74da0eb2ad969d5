"""Rows out of pages: rows of tables, blocks of cards.

Of each kind of tag an opening ends at the next closing on its level; a closing without an opening
closes nothing, and what is never closed ends with the page.  What lies inside an element follows from these ends.
A page's tags are gone through once, inside a task; only what a page says leaves it, and no tag is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

from railbird.functions.names import squeeze

TOKEN = r"""(?s)<!--.*?-->|</?[A-Za-z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^<]++|<"""
ATTRIBUTE = r"""(?is)\s{name}\s*=\s*["']?((?<=")[^"]*(?=")|(?<=')[^']*(?=')|(?<=[=\s])[^\s"'>]+)"""
SILENT = r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>"
ROWS_OF_BATCH, TAGS_KNOWN = 10_000, 10_000
# Elements without an end tag, and those that begin a line of their own.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
LINES = ("br", "div", "dd", "dt", "h1", "h2", "h3", "h4", "h5", "h6", "li", "p", "table", "td", "th", "tr", "ul")
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def plain(text: Column) -> Column:
    return squeeze(F.coalesce(text, F.lit("")))


_CUT, _NAME, _SPACE, _CODE = (re.compile(x, re.ASCII) for x in (TOKEN, r"</?([A-Za-z][A-Za-z0-9]*)", r"\s+", r"&#(\d{1,6});"))
_CLASS = re.compile(ATTRIBUTE.format(name="class"), re.ASCII)
ROW_TAGS = {"table": "table", "tr": "row", "td": "cell", "th": "cell", "h4": "h4", "strong": "strong", "a": "a"}
NAMED = ("h4", "strong", "a")


def _said(text: str) -> str:
    """A text with character references of ASCII signs by name, and all by decimal number, as what they stand for."""
    if "&" in text:
        for code in dict.fromkeys(_CODE.findall(text)):
            n = int(code)
            text = text.replace(f"&#{code};", "?" if 0xD800 <= n < 0xE000 else chr(n))
        for name, sign in ENTITIES:
            text = text.replace(name, sign)
    return text.replace("\u00a0", " ")


def _tag(raw: str) -> tuple[str, str, str, str]:
    """(kind or '', tag, '+' for openings, '-' for closings, else '', what it says) of a tag; a comment's tag is '!'."""
    if raw[1] == "!":
        return "", "!", "", ""
    tag = _NAME.match(raw)[1].lower()
    turn = "" if tag in VOID else "-" if raw[1] == "/" else "" if raw.endswith("/>") else "+"
    return ROW_TAGS.get(tag, "") if turn else "", tag, turn, "\n" if tag in LINES else ""


def _first_marked(page: list[str], marked: str | None, th_class: str | None) -> int | None:
    """The place of the first table that has a sign in it: the outermost one open at the first sign inside any."""
    open_ = []
    for pos, raw in enumerate(page):
        if raw[0] != "<" or raw == "<":
            sign = marked is not None and open_ and marked in _said(raw)
        else:
            kind, tag, turn, _ = _tag(raw)
            if kind == "table":
                if turn == "+":
                    open_.append(pos)
                elif open_:
                    open_.pop()
            found = _CLASS.search(raw) if th_class and open_ and tag == "th" and turn == "+" else None
            sign = found is not None and th_class in _SPACE.split(found[1].strip(" "))
        if sign:
            return open_[0]
    return None


def _rows_of(html: str, marked: str | None, th_class: str | None, known: dict[str, tuple]) -> Iterator[tuple[int, int, list[tuple]]]:
    """(table_no, row_no, cells) of a page; of a cell its place, opening tag, text, and the texts of its first h4, strong and a.  ``known`` keeps what tags are."""
    page = _CUT.findall(html)
    low = _first_marked(page, marked, th_class) if marked or th_class else -1
    if low is None:
        return
    open_: dict[str, list[int]] = {t: [] for t in ROW_TAGS}
    now = dict.fromkeys(ROW_TAGS.values(), -1)  # the last opening of each kind, while it isn't closed
    row = cell = -1
    inner, live, cells = False, [], []  # in a cell of a row of a table; named elements that are open
    parts, first, texts = [], {}, {}
    for pos, raw in enumerate(page):
        kind = turn = ""
        if raw[0] != "<" or raw == "<":
            said = _said(raw) if inner else ""
        else:
            about = known.get(raw)
            if about is None:
                if len(known) >= TAGS_KNOWN:
                    known.clear()
                about = known[raw] = _tag(raw)
            kind, tag, turn, said = about
            if tag == "!":
                continue
            if kind == "table" and turn == "-" and open_[tag][-1:] == [low]:
                break
            if kind and turn == "+":
                open_[tag].append(pos)
                now[kind] = pos
                live = [(n, now[n]) for n in NAMED if now[n] >= 0]
                inner = low <= now["table"] < now["row"] < now["cell"] and now["table"] >= 0
        if inner:
            if now["cell"] != cell:
                if now["row"] != row:
                    if cells:
                        yield table, row, cells
                    table, row, cells = now["table"], now["row"], []
                cell, parts, first, texts = pos, [], {}, {}
                cells.append((pos, raw, parts, texts))
            if said:
                if not (kind == "cell" and turn == "+"):
                    parts.append(said)
            for n, start in live:
                if first.setdefault(n, start) == start:
                    texts.setdefault(n, []).append(said)
        if kind and turn == "-" and open_[tag]:
            start = open_[tag].pop()
            if start == now[kind]:
                now[kind] = -1
                live = [(n, now[n]) for n in NAMED if now[n] >= 0]
                inner = low <= now["table"] < now["row"] < now["cell"] and now["table"] >= 0
    if cells:
        yield table, row, cells


def _flat(text: str) -> str:
    """``plain`` of one text."""
    return b" ".join(text.encode().split()).decode()


def _named(texts: dict[str, list[str]]) -> str | None:
    """The text of a cell's first h4, else strong, else a."""
    return next((_flat("".join(texts[n])) for n in NAMED if n in texts), None)


def _column(values: list, kind: pa.DataType) -> pa.Array:
    """An array of values, of which lists of structs are lists of tuples."""
    if not (pa.types.is_list(kind) and pa.types.is_struct(kind.value_type)):
        return pa.array(values, kind)
    fields = list(kind.value_type)
    flat = [x for rows in values for x in rows]
    parts = zip(*flat, strict=True) if flat else [()] * len(fields)
    told = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(parts, fields, strict=True)], fields=fields)
    return pa.ListArray.from_arrays(pa.array(list(accumulate(map(len, values), initial=0)), pa.int32()), told)


def page_rows(pages: DataFrame, keys: tuple[str, ...], tell: Callable[[str, dict], Iterator[tuple]], columns: list[tuple[str, pa.DataType]], html: str = "html") -> DataFrame:
    """Keys and ``columns`` of a row per tuple that ``tell`` gives of a page; its second argument keeps what tags are.

    Pages stay in the tasks that hold them, and what is carried from row to row of a page needs no shuffle.
    """
    bare = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), SILENT, " ")
    schema = StructType([*(pages.schema[k] for k in keys), *from_arrow_schema(pa.schema(columns)).fields])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {}
        for b in batches:
            at, told = [], []

            def out() -> pa.RecordBatch:  # of the pages since the last one
                said = [_column(list(c), kind) for c, (_, kind) in zip(zip(*told, strict=True), columns, strict=True)]
                return pa.RecordBatch.from_arrays([*(c.take(pa.array(at, pa.int64())) for c in b.columns[:-1]), *said], schema.names)

            for i, page in enumerate(b.column(b.num_columns - 1)):
                for row in tell(page.as_py(), known):
                    at.append(i)
                    told.append(row)
                    if len(at) >= ROWS_OF_BATCH:
                        yield out()
                        at, told = [], []
            if at:
                yield out()

    return pages.select(*keys, bare.alias("_html")).mapInArrow(rows, schema)


@lru_cache(TAGS_KNOWN)
def _cell(raw: str) -> tuple[str, frozenset[str]]:
    """(tag, classes) of a cell's opening tag."""
    classes = _CLASS.search(raw)
    return raw[1:3].lower(), frozenset(_SPACE.split(classes[1].strip(" "))) if classes else frozenset()


_RACE_TOLD = re.compile(r"Race:?\s*(\d+)", re.ASCII | re.IGNORECASE)


def change_rows(html: str, known: dict[str, tuple]) -> Iterator[tuple]:
    """(row_no, race_number, head, n, horses, one, two, change, short) of a change table's rows from its first race on.

    ``head`` is the th of class race, of whose number the race goes on; ``n`` counts td and ``horses`` those of class horse, of which ``one``
    and ``two`` are the first; ``change`` is that of class changes; ``short`` are all texts of a row of two td at most.
    """
    race = None
    for _, row, cells in _rows_of(html, "Changes", "changes", known):
        head = change = None
        tds, horses = [], []
        for _, raw, parts, _ in cells:
            tag, classes = _cell(raw)
            if tag == "td":
                tds.append(parts)
                if "horse" in classes:
                    horses.append(parts)
                if change is None and "changes" in classes:
                    change = _flat("".join(parts))
            elif tag == "th" and head is None and "race" in classes:
                head = _flat("".join(parts))
        if head is not None and (number := _RACE_TOLD.search(head)) and int(number[1]) < 2**31:
            race = int(number[1])
        if race is not None:
            one, two = ([_flat("".join(h)) for h in horses[:2]] + [None, None])[:2]
            yield row, race, head, len(tds), len(horses), one, two, change, [_flat("".join(t)) for t in tds] if len(tds) <= 2 else None


# What headers of a card's table speak of.
ENTRY_HEADERS = ("#", "pp", "horse", "ml", "jockey", "trainer", "morning")
HEADER_ROLES = (("#", "pgm"), ("pp", "pp"), ("horse", "horse"), ("trainer", "people"), ("jockey", "people"), ("ml", "odds"))


def header_roles(headers: list[str]) -> dict[str, int | None]:
    """The places of the number, post position, horse, trainer and jockey, and odds columns; usual places where a name is missing, none for the post position."""
    places: dict[str, int | None] = {"pgm": 0, "pp": None, "horse": 2, "people": 3, "odds": 4}
    for i, header in enumerate(headers):
        role = next((r for word, r in HEADER_ROLES if word in header.lower()), None)
        if role:
            places[role] = i
    return places


def entry_rows(html: str, known: dict[str, tuple]) -> Iterator[tuple]:
    """(race_number, row_no, program_number, horse_name, trainer_name, jockey_name, odds) of rows of a page's tables whose headers speak of two columns of a card."""
    rows = list(_rows_of(html, None, None, known))
    heads: dict[int, list[str]] = {}
    for table, _, cells in rows:
        heads.setdefault(table, []).extend(_flat("".join(parts)) for _, raw, parts, _ in cells if _cell(raw)[0] == "th")
    cards = sorted(t for t, said in heads.items() if sum(any(k in h.lower() for k in ENTRY_HEADERS) for h in said) >= 2)
    roles = {t: (i + 1, header_roles(heads[t])) for i, t in enumerate(cards)}
    for table, row, cells in rows:
        tds = [c for c in cells if _cell(c[1])[0] == "td"] if table in roles else []
        if not tds:
            continue
        race, place = roles[table]
        cell = {k: tds[i] if i is not None and i < len(tds) else None for k, i in place.items()}
        said = lambda c: _flat("".join(c[2])) if c else ""
        lines = lambda c: [t for t in map(_flat, "".join(c[2]).split("\n")) if t] if c else []
        horse, people = cell["horse"], lines(cell["people"]) + [None, None]
        name = _named(horse[3]) if horse else None
        if name is None:
            name = next(iter(lines(horse)), None)
        yield race, row, said(cell["pgm"]) or said(cell["pp"]) or "0", name, people[0], people[1], said(cell["odds"]) if cell["odds"] else None


# Blocks of cards.  What an opening marks, by its tag; a mark lasts until the last opening that has it ends, also inside others of its kind.
MARKS = {
    "div": ("race", "info", "contenders", "row", "saddle", "cloth"), "a": ("link", "horse", "rider", "coach"),
    "h3": ("h3",), "h4": ("h4",), "h5": ("h5",), "tr": ("tr",), "td": ("td",),
}
LINKS = (("horse", "type=Horse"), ("rider", "searchType=J"), ("coach", "searchType=T"))
_ID, _HREF = (re.compile(ATTRIBUTE.format(name=n), re.ASCII) for n in ("id", "href"))
_END = r"(?:\r\n|[\n\r\u0085\u2028\u2029])?\Z"  # where lines may end, as Spark's expressions see it
_RACE, _FRACTION = re.compile(r"Race(\d+)" + _END, re.ASCII), re.compile(r"\d+/\d+" + _END, re.ASCII)
_JOCKEY, _TRAINER, _ODDS = (re.compile(x, re.ASCII | re.IGNORECASE) for x in ("Jockey:", "Trainer:", "M/L Odds:"))
_PRICE = re.compile(r"M/L Odds:\s*([\d/]+|[\d.]+)", re.ASCII | re.IGNORECASE)


def _marked(raw: str) -> tuple[str, str, str, tuple[str, ...]]:
    """(tag, '+' for openings, '-' for closings, else '', what it says, marks of an opening) of a tag; a comment's tag is '!'."""
    _, tag, turn, said = _tag(raw)
    marks = MARKS.get(tag, ()) if turn == "+" else ()
    if marks and tag in ("div", "a"):
        of = lambda sign: (sign.search(raw) or ("", ""))[1]
        if tag == "a":
            href = of(_HREF)
            marks = ("link", *(k for k, v in LINKS if v in href))
        else:
            classes = of(_CLASS)
            own = _SPACE.split(classes.strip(" "))
            has = (_RACE.match(of(_ID)), "race-info" in classes, "contenders" in own, "row" in own, "saddlecloth" in classes, "paddingSaddleCloths" in classes)
            marks = tuple(m for m, yes in zip(marks, has, strict=True) if yes)
    return tag, turn, said, marks


def _entries_in_rows(rows: dict[int, dict]) -> list[tuple]:
    """(row_no, number, name, jockey, trainer, odds) of rows with a saddlecloth; of each the first div that tells it."""
    out = []
    for no, divs in rows.items():
        number = name = jockey = trainer = odds = None
        for d in sorted(k for k in divs if k >= 0):
            d = divs[d]
            text = "".join(d["text"])
            if number is None and d["saddle"]:
                number = (_flat("".join(d["number"])),)
            if name is None and "name" in d:
                name = _flat("".join(d["name"]))
            if ":" in text:
                if jockey is None and _JOCKEY.search(text):
                    jockey = (_flat("".join(d["link"])) if "link" in d else None,)
                if trainer is None and _TRAINER.search(text):
                    trainer = (_flat("".join(d["link"])) if "link" in d else None,)
                if odds is None and _ODDS.search(text):
                    price = _PRICE.search(text)
                    odds = (price[1] if price else None,)
        if number:
            out.append((no, number[0], name, *(x[0] if x else None for x in (jockey, trainer, odds))))
    return out


def _entries_in_lines(lines: dict[int, dict]) -> list[tuple]:
    """(row_no, number, name, jockey, trainer, odds) of table rows of three cells at least, one of them with a saddlecloth; of each the first cell that tells it."""
    out = []
    for no, cells in lines.items():
        if len(cells) < 3:
            continue
        first, odds = {}, None
        for c in cells.values():
            for what in ("cloth", "horse", "rider", "coach"):
                if what in c and what not in first:
                    first[what] = _flat("".join(c[what]))
            if odds is None and _FRACTION.match(text := _flat("".join(c["text"]))):
                odds = text
        if "cloth" in first:
            out.append((no, first["cloth"], *(first.get(k) for k, _ in LINKS), odds))
    return out


def card_blocks(html: str, known: dict[str, tuple]) -> Iterator[tuple]:
    """(number, race_type, told, in_rows, entries) of a page's blocks ``div#RaceN`` that have entries; ``told`` are texts of the race between '|'."""
    open_: dict[str, list[int]] = {t: [] for t in MARKS}
    divs = open_["div"]
    now = {m: -1 for marks in MARKS.values() for m in marks}  # the last opening with each mark, while it isn't closed
    block = None
    # What is said goes to these lists, until a tag changes them; ``told``: that of texts of the race, ``cloth``: a div whose saddlecloth says something.
    aims, told, cloth, stale = [], None, None, False

    def out() -> Iterator[tuple]:
        entries = _entries_in_rows(block["rows"]) if block["in_rows"] else _entries_in_lines(block["lines"])
        if entries:
            yield block["number"], _flat("".join(block["h3"])) if "h3" in block else None, "|".join(block["told"]), block["in_rows"], entries

    def first(acc: dict, what: str, start: int) -> None:  # only the first element of a kind is heard
        if acc.setdefault(("at", what), start) == start:
            aims.append(acc.setdefault(what, []))

    for pos, raw in enumerate(_CUT.findall(html)):
        marks, ended = (), -1
        if raw[0] != "<" or raw == "<":
            if now["race"] < 0:
                continue
            tag, turn, said = "", "", _said(raw)
        else:
            about = known.get(raw)
            if about is None:
                if len(known) >= TAGS_KNOWN:
                    known.clear()
                about = known[raw] = _marked(raw)
            tag, turn, said, marks = about
            if tag == "!":
                continue
            if turn and tag in MARKS:
                if turn == "+":
                    open_[tag].append(pos)
                    for m in marks:
                        now[m] = pos
                    stale = stale or marks or tag == "div"
                elif open_[tag]:
                    ended = open_[tag].pop()
                    stale = stale or tag == "div"
        if stale:
            stale, aims, told, cloth = False, [], None, None
            race, contenders, row = now["race"], now["contenders"], now["row"]
            if race >= 0:
                if block is None or block["start"] != race:
                    if block:
                        yield from out()
                    block = {"start": race, "number": _RACE.match(_ID.search(raw)[1])[1], "told": [], "in_rows": False, "rows": {}, "lines": {}}
                if now["info"] >= 0:
                    if now["h3"] >= 0:
                        first(block, "h3", now["h3"])
                    if now["h5"] >= 0:
                        told = block["told"]
                if contenders >= 0:
                    block["in_rows"] = True
                    if row > contenders:
                        inner = block["rows"].setdefault(row, {})
                        at = divs[-1] if divs else -1
                        acc = inner.get(at)
                        if acc is None:
                            acc = inner[at] = {"text": [], "number": [], "saddle": False}
                        aims.append(acc["text"])
                        if now["saddle"] >= 0:
                            aims.append(acc["number"])
                            cloth = None if acc["saddle"] else acc
                        if now["link"] >= 0:
                            first(acc, "link", now["link"])
                            if now["h4"] >= 0:
                                first(acc, "name", now["link"])
                elif now["td"] > now["tr"] > race:
                    cell = block["lines"].setdefault(now["tr"], {}).setdefault(now["td"], {"text": []})
                    aims.append(cell["text"])
                    for what in ("cloth", "horse", "rider", "coach"):
                        if now[what] >= 0:
                            first(cell, what, now[what])
        if said:
            for heard in aims:
                heard.append(said)
            if told is not None and not tag:
                told.append(_flat(said))
        if cloth is not None and turn != "-":
            cloth["saddle"], cloth = True, None
        if ended >= 0:
            for m in MARKS[tag]:
                if now[m] == ended:
                    now[m] = -1
                    stale = True
    if block:
        yield from out()


def table_rows(pages: DataFrame, keys: tuple[str, ...] = ("doc_id",), html: str = "html", marked: str | None = None, th_class: str | None = None) -> DataFrame:
    """A row per table row: keys, table_no, row_no, cells (cell_no, tag, classes, text, named).

    ``text`` keeps line breaks of blocks; ``named`` is the text of the cell's first h4, else strong, else a.  With ``marked``
    or ``th_class`` only rows of a page's first table that has that text, or a th of that class.
    Rows of nested tables are rows of their own, without the cells around them.
    """
    bare = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), SILENT, " ")
    # Dealt by page, in as many tasks as there is to read: a task holds a batch of pages and never their tags.
    dealt = pages.repartition(*keys).select(*keys, bare.alias("_html"))
    kind = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keys)
    cell = pa.struct([("cell_no", pa.int32()), ("tag", pa.string()), ("classes", pa.string()), ("text", pa.string()), ("named", pa.string())])
    names = [*keys, "table_no", "row_no", "cells"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, tables, numbers, ends, flat, known = [], [], [], [0], [], {}

            def out() -> pa.RecordBatch:  # of the pages since the last one
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*flat, strict=True), cell, strict=True)], fields=list(cell)))
                return pa.RecordBatch.from_arrays([*(c.take(pa.array(at, pa.int64())) for c in b.columns[:-1]), pa.array(tables, pa.int32()), pa.array(numbers, pa.int32()), lists], names)

            for i, page in enumerate(b.column(b.num_columns - 1)):
                for table, row, cells in _rows_of(page.as_py(), marked, th_class, known):
                    at.append(i)
                    tables.append(table)
                    numbers.append(row)
                    for no, raw, parts, texts in cells:
                        classes = _CLASS.search(raw)
                        flat.append((no, raw[1:3].lower(), classes[1] if classes else "", "".join(parts), _named(texts)))
                    ends.append(len(flat))
                    if len(at) >= ROWS_OF_BATCH:
                        yield out()
                        at, tables, numbers, ends, flat = [], [], [], [0], []
            if at:
                yield out()

    return dealt.mapInArrow(rows, f"{kind}, table_no int, row_no int, cells array<struct<cell_no int, tag string, classes string, text string, named string>>")


def of_tag(cells: Column, tag: str) -> Column:
    return F.filter(cells, lambda c: c["tag"] == tag)


def text_at(cells: Column, i: int | Column) -> Column:
    """The text of the i-th of some cells; null without one."""
    found = F.get(cells, F.lit(i) if isinstance(i, int) else i)
    return F.when(found.isNotNull(), plain(found["text"]))
