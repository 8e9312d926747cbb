"""Text functions as columns. Unicode normalisation, HTML tables and overlaps need Python, and all get Arrow batches."""

from __future__ import annotations

import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.schema import SETTINGS

# Format characters that are newer than the JVM's tables.
_NEWER_FORMAT = "\\x{890}\\x{891}\\x{13439}-\\x{1343F}"


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def nfc(c: Column) -> Column:
    """Composed Unicode. Texts of characters before U+0300, where the combining ones begin, are composed already, and Python does not see them."""

    @F.pandas_udf("string")
    def compose(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))

    beyond = F.rlike(c, F.lit(r"[^\x{0}-\x{2FF}]"))
    return F.when(beyond, compose(F.when(beyond, c))).otherwise(c)


def sanitize(c: Column) -> Column:
    """Null to '', line ends to LF, composed Unicode, and no control, format or surrogate characters but LF and TAB."""
    lines = F.regexp_replace(F.coalesce(c, F.lit("")), "\r\n?", "\n")
    return F.regexp_replace(nfc(lines), rf"[\p{{Cc}}\p{{Cf}}\p{{Cs}}{_NEWER_FORMAT}&&[^\n\t]]", "")


def clean_filename(c: Column) -> Column:
    return strip(sanitize(F.when(F.coalesce(c, F.lit("")) == "", "upload.pdf").otherwise(c)))


def extension(c: Column) -> Column:
    return F.when(F.contains(c, F.lit(".")), F.lower(F.substring_index(c, ".", -1))).otherwise("")


def text_rows(c: Column) -> Column:
    """Cells of each non-blank line: split at tabs, else at bars if ' | ' occurs (outer bars dropped), else one cell."""
    lines = F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != "")

    def cells(line: Column) -> Column:
        barred = F.split(F.regexp_replace(line, r"^\|+|\|+$", ""), r"\|")
        parts = F.when(F.contains(line, F.lit("\t")), F.split(line, "\t")).when(F.contains(line, F.lit(" | ")), barred).otherwise(F.array(line))
        return F.transform(parts, strip)

    return F.transform(lines, cells)


def markdown(rows: Column) -> Column:
    """A Markdown table of array<array<string>>; '' without rows or cells. Short rows are filled up, the first one is the head."""
    empty = F.array().cast("array<string>")

    def table(width: Column) -> Column:
        def line(row: Column) -> Column:
            cells = F.transform(row, lambda x: F.replace(F.replace(F.coalesce(x, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>")))
            filled = F.concat(cells, F.array_repeat(F.lit(""), (width - F.size(row)).cast("int")))
            return F.concat(F.lit("| "), F.array_join(filled, " | "), F.lit(" |"))

        lines = F.transform(rows, line)
        rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
        whole = F.concat(F.slice(lines, 1, 1), F.array(rule), F.when(F.size(rows) > 1, F.slice(lines, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0)))).otherwise(empty))
        return F.when(width <= 0, "").otherwise(F.array_join(whole, "\n"))

    width = F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0)).cast("int")
    return F.when(F.coalesce(F.size(rows), F.lit(0)) <= 0, "").otherwise(F.element_at(F.transform(F.array(width), table), 1))


class _Events(HTMLParser):
    """What the markup says, in order: (tag, None), (/tag, None) or ("", text)."""

    def __init__(self):
        super().__init__()
        self.found: list[tuple[str, str | None]] = []

    def handle_starttag(self, tag, attrs):
        self.found.append((tag, None))

    def handle_endtag(self, tag):
        self.found.append((f"/{tag}", None))

    def handle_data(self, data):
        self.found.append(("", data))


def parse_html_rows(html: str | None) -> list[list[str]]:
    """Rows of the tables in `html`, each as often as it is closed, as it stands at the end of the text. A cell's end tag adds the text since the last
    cell began, so a stray one repeats the cell before it; text outside cells, and rows without cells or never closed, are left out."""
    if "<table" not in (html or "").lower():
        return []
    events = _Events()
    try:
        events.feed(html)
    except Exception:  # noqa: BLE001 - broken markup gives no rows
        return []
    rows: list[list[str]] = [[]]
    closed, cell, inside = [], "", False
    for what, data in events.found:
        match what:
            case "" if inside:
                cell += data
            case "td" | "th":
                cell, inside = "", True
            case "/td" | "/th":
                rows[-1].append(cell.strip())
                inside = False
            case "tr":
                rows.append([])
            case "/tr" if rows[-1]:
                closed.append(len(rows) - 1)
    return [list(rows[i]) for i in closed]


def html_rows(c: Column) -> Column:
    @F.pandas_udf("array<array<string>>")
    def parse(s: pd.Series) -> pd.Series:
        return s.map(parse_html_rows)

    return parse(c)


#: Places that are tried one by one before the prefix function is worked out.
TRIED = 64


def overlap(left: str, right: str, cap: int = SETTINGS.overlap_cap) -> int:
    """Length of the longest end of left that right begins with, cap characters at most, in linear time.

    An overlap begins where the first letter of right stands in the end of left; where that is often, the prefix function of right's head,
    carried on over left's tail, tells the longest one.
    """
    most = min(len(left), len(right), cap)
    if not most:
        return 0
    head, tail = right[:most], left[-most:]
    at = tail.find(head[0])
    for _ in range(TRIED):
        if at < 0:
            return 0
        if head.startswith(tail[at:]):
            return most - at
        at = tail.find(head[0], at + 1)
    border, k = [0] * most, 0
    for i in range(1, most):
        while k and head[i] != head[k]:
            k = border[k - 1]
        k += head[i] == head[k]
        border[i] = k
    k = 0
    for c in tail:
        while k and (k == most or c != head[k]):
            k = border[k - 1]
        k += c == head[k]
    return k


def joined(left: str, right: str, cap: int = SETTINGS.overlap_cap) -> str:
    """left and right joined at their overlap, else with a line end between."""
    k = overlap(left, right, cap)
    return left + right[k:] if k else f"{left}\n{right}"


def join_overlap(left: Column, right: Column, cap: int = SETTINGS.overlap_cap) -> Column:
    """left and right joined at their longest common end and beginning (cap characters at most), else with a line end between; null if one is."""

    @F.pandas_udf("string")
    def join(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else joined(x, y, cap) for x, y in zip(a, b, strict=True)], dtype=object)

    return join(left, right)


def fold_overlaps(texts: Column, cap: int = SETTINGS.overlap_cap) -> Column:
    """The texts of an array joined one after the other, each at its overlap with what is there; only the last `cap` characters of that are looked at."""

    @F.pandas_udf("string")
    def fold(lists: pd.Series) -> pd.Series:
        return pd.Series([folded(list(x), cap) for x in lists], dtype=object)

    return fold(texts)


def folded(texts: list[str], cap: int = SETTINGS.overlap_cap) -> str:
    pieces, end = [texts[0]], texts[0][-cap:]
    for text in texts[1:]:
        k = overlap(end, text, cap)
        pieces.append(text[k:] if k else f"\n{text}")
        end = (end + pieces[-1])[-cap:]
    return "".join(pieces)


def citations(c: Column) -> Column:
    """Numbers of the source tags in a text, ascending and distinct."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\[Source #(\d+)\]"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: x.cast("int"))))


def citations_valid(numbers: Column, sources: Column) -> Column:
    return F.forall(numbers, lambda i: i.between(F.lit(1), sources))
