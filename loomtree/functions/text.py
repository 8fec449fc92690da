"""Text and encoding helpers as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base64_url(raw: Column) -> Column:
    """URL-safe alphabet, no padding, no line breaks."""
    return F.translate(F.rtrim(F.base64(raw), F.lit("=\r\n")), "+/\r\n", "-_")


def from_base64_url(s: Column) -> Column:
    return F.unbase64(F.translate(s, "-_", "+/"))


def is_base64(s: Column, url: bool = False) -> Column:
    """Whether a text is base64 of the standard alphabet with padding, or URL-safe with or without."""
    return s.rlike(r"^(?:[A-Za-z0-9_-]{4})*(?:[A-Za-z0-9_-]{2}(?:==)?|[A-Za-z0-9_-]{3}=?)?$" if url else r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$")


def crc32(s: Column) -> Column:
    return F.crc32(F.encode(s, "UTF-8"))


def decoded(raw: Column) -> Column:
    """Text of bytes by their byte order mark (UTF-8, UTF-16 of both orders; UTF-8 without), newlines as line feeds."""
    head = F.hex(F.substr(raw, F.lit(1), F.lit(3)))
    text = (
        F.when(head == "EFBBBF", F.decode(F.substr(raw, F.lit(4)), "UTF-8"))
        .when(head.startswith("FFFE"), F.decode(F.substr(raw, F.lit(3)), "UTF-16LE"))
        .when(head.startswith("FEFF"), F.decode(F.substr(raw, F.lit(3)), "UTF-16BE"))
        .otherwise(F.decode(raw, "UTF-8"))
    )
    return unix_newlines(text)


def hex_lower(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def indent(s: Column, prefix: str) -> Column:
    """Puts the prefix before every line that is not blank."""
    return F.regexp_replace(s, r"(?m)^(?=.*\S)", prefix.replace("\\", "\\\\").replace("$", "\\$"))


def dedent(s: Column) -> Column:
    """Takes off the common leading blanks of the lines that are not blank."""
    lines = F.split(s, "\n")
    widths = F.transform(F.filter(lines, lambda x: F.trim(x) != ""), lambda x: F.char_length(x) - F.char_length(F.ltrim(x)))
    least = F.coalesce(F.array_min(widths), F.lit(0))
    return F.array_join(F.transform(lines, lambda x: F.substr(x, F.least(least, F.char_length(x) - F.char_length(F.ltrim(x))) + 1, F.char_length(x) + 1)), "\n")


def trim_lines(s: Column) -> Column:
    return F.array_join(F.transform(F.split(s, "\n"), F.trim), "\n")


def line_count(s: Column) -> Column:
    """A last newline ends a line and starts none."""
    return F.when(s == "", 0).otherwise(F.size(F.split(F.regexp_replace(s, r"\n\z", ""), "\n")))


def unix_newlines(s: Column) -> Column:
    return F.regexp_replace(s, r"\r\n|\r", "\n")


def xml_escaped(s: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        s = F.replace(s, F.lit(raw), F.lit(entity))
    return s


def json_minified(s: Column) -> Column:
    """Without white space, keys sorted; NULL if it is no JSON."""
    return F.to_json(F.try_parse_json(s))


def json_pretty(value: Column) -> Column:
    """A struct, map, array or VARIANT as JSON over several lines."""
    return F.to_json(value, {"pretty": "true"})


def json_escaped(s: Column) -> Column:
    """The text as a JSON string, quotes included."""
    return F.to_json(s.cast("variant"))


def csv_escaped(s: Column, delimiter: str = ",") -> Column:
    """A cell in quotes if it holds a delimiter, a quote or a line break."""
    return F.when(s.rlike("[\"\r\n]") | s.contains(delimiter), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def within_limits(s: Column, max_bytes: int = 64 << 20, max_brackets: int | None = None) -> Column:
    """Whether a document's text is small enough to parse: its bytes, and its opening brackets, which bound its depth."""
    brackets = F.char_length(s) - F.char_length(F.translate(s, "[{", ""))
    small = F.octet_length(s) <= max_bytes
    return small if max_brackets is None else small & (brackets <= max_brackets)


def lenient_json(s: Column) -> Column:
    """A VARIANT of JSON with comments, single quotes, unquoted names, NaN, leading zeros and trailing commas in; NULL if it is none."""
    plain = F.regexp_replace(s, r'("(?:[^"\\]|\\.)*")|,(\s*[}\]])', "$1$2")
    options = {"allowComments": "true", "allowSingleQuotes": "true", "allowUnquotedFieldNames": "true", "allowNonNumericNumbers": "true", "allowNumericLeadingZeros": "true"}
    return F.from_json(plain, "variant", options)


def frontmatter(s: Column) -> Column:
    """struct(format, frontmatter, content): --- fences YAML, +++ fences TOML; no fence leaves the text alone."""
    s = unix_newlines(s)
    yaml, toml = r"(?s)\A---[ \t]*\n(.*?)\n?---[ \t]*(?:\n|\z)", r"(?s)\A\+\+\+[ \t]*\n(.*?)\n?\+\+\+[ \t]*(?:\n|\z)"
    kind = F.when(s.rlike(yaml), "yaml").when(s.rlike(toml), "toml")
    head = F.when(kind == "yaml", F.regexp_extract(s, yaml, 1)).when(kind == "toml", F.regexp_extract(s, toml, 1))
    body = F.when(kind == "yaml", F.regexp_replace(s, yaml, "")).when(kind == "toml", F.regexp_replace(s, toml, "")).otherwise(s)
    return F.struct(kind.alias("format"), head.alias("frontmatter"), body.alias("content"))
