"""Text, name and identity functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of identity normalisation: it keeps U+3000.
NORMAL_SPACE = r"[\t\n\r\f\x0B \x{00a0}]"
#: White space of snippets: that of scripts on the web, which holds U+3000, and no-break spaces.
SNIPPET_SPACE = r"[\t\n\r\f\x0B \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
#: Lengths at which texts are cut, fixed values.
QUOTE_CHARS, SUMMARY_CHARS, SNIPPET_CHARS = 160, 80, 60


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def collapse(text, space: str) -> Column:
    return F.regexp_replace(F.regexp_replace(_col(text), space + "+", " "), "^ | $", "")


def normalize_text(text) -> Column:
    """Runs of NORMAL_SPACE become one blank, ends are trimmed."""
    return collapse(text, NORMAL_SPACE)


def snippet(text, limit: int = SNIPPET_CHARS) -> Column:
    """Collapsed by SNIPPET_SPACE and cut to limit code points, with an ellipsis if cut."""
    return cut(collapse(text, SNIPPET_SPACE), limit)


def cut(text, limit: int) -> Column:
    text = _col(text)
    return F.when(F.char_length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("…"))).otherwise(text)


def truncate(text) -> Column:
    """A summary: the normalised text, cut to 80 code points."""
    return cut(normalize_text(text), SUMMARY_CHARS)


def quote(text) -> Column:
    return F.left(normalize_text(text), F.lit(QUOTE_CHARS))


def match_key(text) -> Column:
    """Key by which headings are matched: white space collapsed, lower case (not full case folding: ß stays)."""
    return F.lower(collapse(text, SNIPPET_SPACE))


def joined(*parts) -> Column:
    """Parts with NUL between them."""
    out: list[Column] = []
    for p in parts:
        out += [F.char(F.lit(0)), _col(p)] if out else [_col(p)]
    return F.concat(*out)


def node_digest(kind, text) -> Column:
    """SHA-256 of kind, NUL and the normalised text."""
    return F.sha2(joined(kind, normalize_text(text)), 256)


def semantic_id(part, kind, para_id, path) -> Column:
    """First 32 hex digits of the SHA-256 of part, kind and native paragraph id, or the path if there is none."""
    key = F.coalesce(F.nullif(_col(para_id), F.lit("")), _col(path))
    return F.left(F.sha2(joined(part, kind, key), 256), F.lit(32))


def selector_count(para_id, path, quoted) -> Column:
    """How many of an anchor's three independent selectors are there."""
    return sum(((F.coalesce(_col(x), F.lit("")) != "").cast("int") for x in (para_id, path, quoted)), F.lit(0))


def is_weak(para_id, path, quoted) -> Column:
    return selector_count(para_id, path, quoted) < 2


def build_path(parent, local, index) -> Column:
    """Path of a child: parent/w:local[index], index from 1."""
    return F.concat(_col(parent), F.lit("/w:"), _col(local), F.lit("["), _col(index).cast("string"), F.lit("]"))


def pointer(part, path) -> Column:
    return F.concat(_col(part), F.lit("!"), _col(path))


def paragraph_key(key) -> Column:
    """A made-up native paragraph id: 31 bits of the SHA-256 as 8 upper-case hex digits, never 0."""
    bits = F.conv(F.left(F.sha2(_col(key), 256), F.lit(8)), 16, 10).cast("bigint").bitwiseAND(F.lit(0x7FFFFFFF))
    return F.lpad(F.hex(F.greatest(bits, F.lit(1))), 8, "0")


# --- names ----------------------------------------------------------------------------------------------------------


def local_name(tag) -> Column:
    return F.regexp_replace(_col(tag), r"^\{[^}]*\}", "")


def extension(path) -> Column:
    """Lower-case suffix after the last dot of the last segment; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(_col(path), r"\.([^./\\]+)$", 1)), F.lit(""))


def stem(name, limit: int = 80) -> Column:
    """A file name without its extension, other characters than letters, digits, . _ and - as _."""
    return F.left(F.regexp_replace(F.regexp_replace(_col(name), r"\.[^.]+$", ""), r"[^\w.\-]+", "_"), F.lit(limit))


#: A style of the heading family by its whole name, fixed values.
_HEADING = r"(?i)^\s*(?:heading|标题)\s*([1-9]?)\s*$"


def name_level(style_id, style_name) -> Column:
    """Heading level by a style's name, else its id: 'heading 3' or the Chinese word, no digit is 1; other names that begin
    so and end in digits, 'Heading Appendix 12', give that number, which callers clamp."""

    def level(x) -> Column:
        x = F.coalesce(_col(x), F.lit(""))
        ahead = F.nullif(F.regexp_extract(x, r"(?i)^\s*(?:heading|标题).*?([0-9]+)\s*$", 1), F.lit(""))
        own = F.coalesce(F.nullif(F.regexp_extract(x, _HEADING, 1), F.lit("")).cast("int"), F.lit(1))
        return F.when(x.rlike(_HEADING), own).when(ahead.isNotNull(), F.coalesce(ahead.try_cast("int"), F.lit(2147483647)))

    return F.coalesce(level(style_name), level(style_id))


def is_heading_style(outline, style_id, style_name) -> Column:
    """Whether a style is of the heading family: it has an outline level, or is named so as a whole."""
    named = [F.coalesce(_col(x), F.lit("")).rlike(_HEADING) for x in (style_name, style_id)]
    return _col(outline).isNotNull() | named[0] | named[1]


def heading_level(own_outline, chain_outline, style_id, style_name) -> Column:
    """Level 1 to 9: outline level (0-based; the paragraph's own before its style chain's), else by name."""
    outline = F.coalesce(_col(own_outline), _col(chain_outline))
    return F.coalesce(clamp(outline + 1, 1, 9), clamp(name_level(style_id, style_name), 1, 9))


def level_source(own_outline, chain_outline, style_id, style_name) -> Column:
    outline = F.coalesce(_col(own_outline), _col(chain_outline))
    return F.when(outline.isNotNull(), "outlineLevel").when(name_level(style_id, style_name).isNotNull(), "styleName")


def relationship_source(rels_part) -> Column:
    """The part that a .rels part describes: word/_rels/document.xml.rels gives word/document.xml, _rels/.rels ''."""
    return F.regexp_replace(_col(rels_part), r"(^|/)_rels/([^/]*)\.rels$", "$1$2")


def resolve_target(source_part, target) -> Column:
    """A relationship's target against its source part, with . and .. taken up; a leading / starts at the root."""
    source, target = _col(source_part), _col(target)
    folder = F.regexp_replace(source, r"[^/]*$", "")
    whole = F.when(target.startswith("/"), F.substring(target, 2, 1 << 30)).otherwise(F.concat(folder, target))
    steps = F.filter(F.split(whole, "/"), lambda s: (s != "") & (s != "."))
    empty = F.array().cast("array<string>")
    walked = F.aggregate(
        steps,
        empty,
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, s)),
    )
    return F.array_join(walked, "/")


def uri_scheme(uri) -> Column:
    """What kind of place a uri names: local, refused (remote or inline), or unknown."""
    uri = _col(uri)
    scheme = F.lower(F.regexp_extract(uri, r"^([A-Za-z][A-Za-z0-9+.\-]+):", 1))
    return (
        F.when((scheme == "") | (scheme == "file"), "local")
        .when(scheme.isin("http", "https", "memory", "data", "s3", "gs"), "refused")
        .otherwise("unknown")
    )


# --- markup ---------------------------------------------------------------------------------------------------------


def xml_escape(text) -> Column:
    out = _col(text)
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(raw), F.lit(name))
    return out


def decode_entities(text) -> Column:
    """The usual named entities; &amp; last."""
    out = _col(text)
    for name, raw in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(raw))
    return out


def plain_text(markup) -> Column:
    return F.regexp_replace(_col(markup), "<[^>]+>", "")


def without_attributes(markup, *names: str) -> Column:
    """Markup without the named attributes, to compare what remains."""
    return F.regexp_replace(_col(markup), r"\s(?:" + "|".join(names) + r')="[^"]*"', "")


def template_names(text) -> Column:
    """Names of the {{name}} tokens of a template, each once, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(_col(text), F.lit(r"\{\{([A-Za-z][A-Za-z0-9_]{0,63})\}\}"), 1)))


def has_broken_token(text) -> Column:
    """Whether braces are left over when the well-formed tokens are taken out."""
    return F.regexp_replace(_col(text), r"\{\{[A-Za-z][A-Za-z0-9_]{0,63}\}\}", "").rlike(r"\{\{|\}\}")


def needs_font(text) -> Column:
    """Characters beyond printable ASCII, tab and line ends ask for an embedded font."""
    return _col(text).rlike(r"[^\x09\x0a\x0d\x20-\x7e]")


def content_type(override, default) -> Column:
    return F.coalesce(_col(override), _col(default))


# --- numbers --------------------------------------------------------------------------------------------------------


def clamp(x, low, high) -> Column:
    return F.when(_col(x).isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), _col(x))))


def half_up(x) -> Column:
    """Rounded to an integer, halves towards plus infinity."""
    return F.floor(_col(x) + 0.5)


def twips(points) -> Column:
    return half_up(_col(points) * 20)


def half_points(points) -> Column:
    return half_up(_col(points) * 2)


def eighths(points) -> Column:
    return half_up(_col(points) * 8)


def emu_from_mm(mm) -> Column:
    return half_up(_col(mm) * 36000)


def twips_from_mm(mm) -> Column:
    return half_up(_col(mm) * 1440 / 25.4)


def points_from_emu(emu) -> Column:
    return _col(emu) / 914400 * 72


def first_line_points(chars_hundredths, indent_twips, size_points) -> Column:
    """First-line indent in points: hundredths of a character by the run size (12 if unknown), else twips."""
    size = F.coalesce(_col(size_points).cast("double"), F.lit(12.0))
    return F.round(F.coalesce(_col(chars_hundredths) / 100 * size, _col(indent_twips) / 20), 2)


def close_to(a, b, tolerance: float = 0.5) -> Column:
    return F.abs(_col(a) - _col(b)) <= tolerance


def rotation(degrees) -> Column:
    return F.pmod(_col(degrees), F.lit(360))


def int_or(text, fallback=None) -> Column:
    value = F.when(F.trim(_col(text)).rlike(r"^[+-]?\d{1,9}$"), F.trim(_col(text)).cast("int"))
    return value if fallback is None else F.coalesce(value, F.lit(fallback))


def is_on(value) -> Column:
    """An on/off attribute: on unless 0, false or off; an absent one is on."""
    return F.coalesce(~F.lower(_col(value)).isin("0", "false", "off"), F.lit(True))


def rgb(value) -> Column:
    """RRGGBB of #rrggbb."""
    return F.upper(F.regexp_replace(_col(value), "^#", ""))


def argb(value) -> Column:
    return F.concat(F.lit("FF"), rgb(value))


def _linear(channel: Column) -> Column:
    c = channel / 255
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def luminance(color) -> Column:
    value = rgb(color)
    channel = [F.conv(F.substring(value, k, 2), 16, 10).cast("double") for k in (1, 3, 5)]
    return 0.2126 * _linear(channel[0]) + 0.7152 * _linear(channel[1]) + 0.0722 * _linear(channel[2])


def contrast_ratio(a, b) -> Column:
    x, y = luminance(a), luminance(b)
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)


def lines_fit(chars, size_points, width_points, height_points) -> Column:
    """Whether a title's lines, at 0.55 em a character and 1.2 leading with 8 points of room, fit a box."""
    lines = F.greatest(F.lit(1), F.ceil(_col(chars) * 0.55 * _col(size_points) / _col(width_points)))
    return lines * _col(size_points) * 1.2 + 8 <= _col(height_points)


def column_number(letters) -> Column:
    """Column of A1 letters: A is 1, AA is 27."""
    chars = F.filter(F.split(F.upper(_col(letters)), ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0), lambda acc, c: acc * 26 + F.ascii(c) - 64)


def column_letters(number) -> Column:
    """A1 letters of a column of 1 to 18278 (three letters)."""
    n = _col(number).cast("int") - 1
    third, second, first = n % 26, F.floor(n / 26) - 1, F.floor((n - 26) / 676) - 1
    letter = lambda k: F.char((k + 65).cast("int"))
    return F.concat(
        F.when(n >= 702, letter(first)).otherwise(""),
        F.when(n >= 26, letter(F.pmod(second, F.lit(26)))).otherwise(""),
        letter(third),
    )


def address_parts(address) -> tuple[Column, Column]:
    """Column and row of an A1 address, null if it is none."""
    ok = _col(address).rlike(r"^(?i)[A-Z]{1,3}[1-9][0-9]{0,6}$")
    col = F.when(ok, column_number(F.regexp_extract(_col(address), "^([A-Za-z]+)", 1)))
    return col, F.when(ok, F.regexp_extract(_col(address), "([0-9]+)$", 1).cast("int"))
