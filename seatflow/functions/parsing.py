"""Numbers, labelled lines and page markup out of text columns."""

from __future__ import annotations

import html
import json
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from seatflow.functions.cleaning import strip

NBSP = "\u00a0"

# Entity names and their texts, from the tables of the standard library. The usual ones come
# first because a map is searched from its start. Names without a semicolon are the old ones
# that pages may write without it; a text that starts with one holds it.
_USUAL = ("amp;", "lt;", "gt;", "quot;", "nbsp;", "apos;")
NAMED = json.dumps({n: html5[n] for n in (*_USUAL, *sorted(n for n in html5 if n.endswith(";") and n not in _USUAL))})
OLD_NAMED = json.dumps({n: t for n, t in sorted(html5.items()) if not n.endswith(";")})
OLD_LENGTHS = sorted({len(n) for n in html5 if not n.endswith(";")}, reverse=True)
# Code points that pages write for the characters of a Windows code page.
WINDOWS = json.dumps({str(n): html.unescape(f"&#{n};") for n in (0, 13, *range(0x80, 0xA0))})

VOID_TAGS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")

# A tag; a '>' inside a quoted attribute does not end it.
_ATTRS = r"""(?:[^>"']|"[^"]*"|'[^']*')*"""
ANY_TAG = rf"(?s)</?[a-zA-Z!]{_ATTRS}>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once however often it occurs there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


# Control characters that stand for a cut; markup text holds none.
CUT, END = "\x02", "\x03"


def cut(col: Column, pattern: str) -> Column:
    """Parts of a text between the matches of a pattern.

    Splitting by a pattern compiles it for every value; replacing keeps it
    compiled, and splitting by one plain character needs none.
    """
    return F.split(F.regexp_replace(col, pattern, CUT), CUT)


def _character(code: Column) -> Column:
    """Text of a code point; a number that is none gives the replacement character."""
    real = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    word = F.unhex(F.lpad(F.hex(code), 8, "0"))
    windows = F.from_json(F.lit(WINDOWS), "map<string,string>")
    return F.coalesce(
        F.when((code < 0xA0) & ((code >= 0x80) | code.isin(0, 13)), F.try_element_at(windows, code.cast("string"))),
        F.when(real, F.decode(word, "UTF-32")),
        F.lit("\ufffd"),
    )


def decode_entities(col: Column) -> Column:
    """Named and numeric entities to text, in one pass; unknown names stay as they are.

    The semicolon may be missing after a number and after the old names.
    """
    return let(col, lambda text: _decode(text))


def _decode(col: Column, closed: bool = False) -> Column:
    """``decode_entities`` of a plain column or lambda variable; with ``closed`` an entity must
    end in its semicolon, and what lacks it stays as it is."""
    named = F.from_json(F.lit(NAMED), "map<string,string>")
    old = F.from_json(F.lit(OLD_NAMED), "map<string,string>")

    def decoded(part: Column) -> Column:
        """A part that began with an ampersand."""
        number = F.regexp_extract(part, r"^#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});" + ("" if closed else "?"), 0)
        digits = F.regexp_replace(number, "[#;]", "")
        code = F.when(digits.rlike("^[xX]"), F.conv(F.substring(digits, 2, 9), 16, 10)).otherwise(digits)
        name = F.regexp_extract(part, r"^[a-zA-Z][a-zA-Z0-9]{0,31};", 0)
        short = [] if closed else [F.substring(part, 1, n) for n in OLD_LENGTHS]
        text = F.coalesce(
            F.when(number != "", F.concat(_character(code.cast("bigint")), F.substring(part, F.length(number) + 1, F.length(part)))),
            F.when(name != "", F.concat(F.try_element_at(named, name), F.substring(part, F.length(name) + 1, F.length(part)))),
            *[F.concat(F.try_element_at(old, s), F.substring(part, F.length(s) + 1, F.length(part))) for s in short],
            F.concat(F.lit("&"), part),
        )
        return text

    parts = cut(col, r"&(?=#[0-9xX]|[a-zA-Z])")
    whole = let(
        parts,
        lambda p: F.array_join(
            F.concat(F.slice(p, 1, 1), F.transform(F.slice(p, F.lit(2), F.size(p)), decoded)), ""
        ),
    )
    return F.when(F.contains(col, F.lit("&")), whole).otherwise(col)


def parse_int(col: Column) -> Column:
    """Whole number after dropping commas and hard blanks; NULL for anything else."""
    digits = strip(F.translate(col, "," + NBSP, ""))
    return F.regexp_extract(digits, r"^[0-9]+$", 0).try_cast("bigint")


def first_number(col: Column) -> Column:
    """First run of digits and dots as a double."""
    return F.regexp_extract(col, r"[0-9.]+", 0).try_cast("double")


def first_int(col: Column) -> Column:
    return F.regexp_extract(col, r"[0-9]+", 0).try_cast("bigint")


def paren_int(col: Column) -> Column:
    """First whole number that stands alone in parentheses."""
    return F.regexp_extract(col, r"\(([0-9]+)\)", 1).try_cast("bigint")


def non_blank_lines(col: Column) -> Column:
    lines = F.transform(cut(col, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), strip)
    return F.filter(lines, lambda line: line != "")


def _after_colon(line: Column) -> Column:
    return strip(F.get(F.split(line, ":"), F.lit(1)))


def parse_tooltip(title: Column, body: Column) -> Column:
    """Struct of code, description and the three labelled figures.

    If a label occurs more than once, the last line wins.
    """

    def fields(lines: Column) -> Column:
        rest = F.slice(lines, F.lit(2), F.size(lines))

        def labelled(label: str) -> Column:
            hits = F.filter(rest, lambda line: F.lower(line).startswith(label))
            return F.try_element_at(hits, F.lit(-1))

        return F.struct(
            let(strip(decode_entities(title)), lambda t: F.nullif(t, F.lit(""))).alias("code"),
            F.try_element_at(lines, F.lit(1)).alias("description"),
            parse_int(_after_colon(labelled("applicants:"))).alias("applicants"),
            parse_int(_after_colon(labelled("vacancies:"))).alias("vacancies"),
            first_number(labelled("ballot chance:")).alias("chance_pct"),
        )

    return let(non_blank_lines(body), fields)


def elements(html: Column, tag: str) -> Column:
    """Inner markup of every ``tag`` element, in order; a missing end tag is tolerated."""
    closed = F.regexp_replace(html, rf"(?i)</{tag}\b", END)
    inner = let(cut(closed, rf"(?i)<{tag}\b{_ATTRS}>"), lambda p: F.slice(p, F.lit(2), F.size(p)))
    return F.transform(inner, lambda part: F.substring_index(part, END, 1))


def without_hidden(html: Column) -> Column:
    """Markup without comments, scripts and styles, which hold no content."""
    return F.regexp_replace(html, rf"(?is)<!--.*?(?:-->|\z)|<(script|style)\b{_ATTRS}>.*?(?:</\1\s*>|\z)", "")


def first_element(html: Column, tag: str) -> Column:
    return F.get(elements(html, tag), F.lit(0))


def inner_text(html: Column, closed: bool = False) -> Column:
    """Text of a fragment: every text node stripped, then joined without a gap.

    With ``closed`` only entities that end in their semicolon are decoded, so that what is left
    of one at the end of a text that was cut off is kept as it stands.
    """
    nodes = F.transform(cut(html, ANY_TAG), lambda t: strip(_decode(t, closed)))
    return F.array_join(nodes, "")


def direct_text(html: Column) -> Column:
    """First text that is not inside a nested element.

    The depth is counted tag by tag, so elements of one name may be nested.
    """
    void = "|".join(VOID_TAGS)
    return let(
        F.struct(cut(html, ANY_TAG).alias("texts"), F.regexp_extract_all(html, F.lit(f"({ANY_TAG})"), F.lit(1)).alias("tags")),
        lambda page: strip(decode_entities(_first_at_top(page["texts"], page["tags"], void))),
    )


def _first_at_top(texts: Column, tags: Column, void: str) -> Column:
    def step(at: Column, pair: Column) -> Column:
        tag, text = F.coalesce(pair["tags"], F.lit("")), pair["texts"]
        free = (at["depth"] == 0) & at["found"].isNull() & (text != "")
        flat = tag.rlike(rf"(?i)^<(?:!|(?:{void})\b)") | tag.endswith("/>") | (tag == "")
        move = F.when(flat, 0).when(tag.startswith("</"), -1).otherwise(1)
        return F.struct(
            F.greatest(at["depth"] + move, F.lit(0)).alias("depth"),
            F.when(free, text).otherwise(at["found"]).alias("found"),
        )

    begin = F.struct(F.lit(0).alias("depth"), F.lit(None).cast("string").alias("found"))
    pairs = F.zip_with(texts, tags, lambda x, t: F.struct(x.alias("texts"), t.alias("tags")))
    return F.aggregate(pairs, begin, step, lambda at: at["found"])


def tag_attributes(html: Column, tag: str, css_class: str) -> Column:
    """Attribute text of the first ``tag`` that carries the class."""
    opened = F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b({_ATTRS})>"), F.lit(1))
    wanted = rf"""(?is)\bclass\s*=\s*(["'])(?:[^"']*\s)?{css_class}(?:\s[^"']*)?\1"""
    return F.get(F.filter(opened, lambda a: a.rlike(wanted)), F.lit(0))


def attribute(attrs: Column, name: str) -> Column:
    """Value of a quoted attribute, entities decoded; NULL if absent or empty."""
    quoted = F.regexp_extract(
        attrs, rf"""(?is)(?<![\w-]){name}\s*=\s*("[^"]*"|'[^']*')""", 1
    )
    return let(quoted, lambda q: _decode(F.when(F.length(q) > 2, F.substring(q, F.lit(2), F.length(q) - 2))))
