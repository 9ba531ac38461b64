"""Names with colours: codes expanded to characters and colours, and runs of one colour marked up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the character after a dollar stands for, as a byte; and the characters of the bytes 0 to 31, the high bit off.
DOLLAR = {
    "\\": 0x0D, ":": 0x0A, "[": 0x10, "]": 0x11, "0": 0x12, "1": 0x13, "2": 0x14, "3": 0x15, "4": 0x16, "5": 0x17, "6": 0x18, "7": 0x19, "8": 0x1A, "9": 0x1B, ",": 0x1C, ".": 0x9C, "<": 0x1D,
    "-": 0x1E, ">": 0x1F, "(": 0x80, "=": 0x81, ")": 0x82, "a": 0x83, "W": 0x84, "G": 0x86, "R": 0x87, "Y": 0x88, "B": 0x89, "b": 0x8B, "c": 0x8D, "d": 0x8D, "$": 0x24, "^": 0x5E,
}
GLYPHS = "     •        · []0123456789•‹—›"

_CHAR = "struct<ch:string,color:string>"
#: One code or character: a dollar, x and two hex digits; a dollar and a known character; a caret and no space; anything else.
_CODE = r"(?s)(\$x[0-9A-Fa-f]{2}|\$[\\:\[\]0-9,.<\->(=)aWGRYBbcd$^]|\^[^ ]|.)"


def _glyph(byte: Column) -> Column:
    base = byte.bitwiseAND(127)
    return F.when(base < 32, F.substring(F.lit(GLYPHS), (base + 1).cast("int"), F.lit(1))).when(base == 127, " ").otherwise(F.chr(base))


def _color(byte: Column) -> Column:
    base = byte.bitwiseAND(127)
    return F.when(base.between(16, 27), "g").when(byte >= 128, "b").otherwise("w")


def expanded_codes(name: Column) -> Column:
    """The characters of a name as it is written in a configuration: an array of ``ch`` and ``color`` (w, b brown, g gold).

    ``$xHH`` is a byte (00 a space), ``$`` and a character one of DOLLAR's, ``^`` and a character that one in brown; a dollar or caret
    that begins none of these stands for itself. Control characters become their glyphs. Characters beyond ASCII stay
    as they are, after a caret too, in brown. A null name has none.
    """
    table = F.create_map(*[F.lit(x) for pair in DOLLAR.items() for x in pair])

    def one(code: Column) -> Column:
        last = F.substring(code, -1, 1)
        coded, caret = F.length(code) > 1, code.startswith("^")
        byte = F.when(F.length(code) == 4, F.conv(F.substring(code, 3, 2), 16, 10).cast("int")).when(coded & caret, F.ascii(last).bitwiseOR(128)).when(coded, F.element_at(table, last)).otherwise(F.ascii(code))
        byte = F.when((F.length(code) == 4) & (byte == 0), 32).otherwise(byte)
        plain = ~coded & (F.ascii(code) >= 32)
        beyond = caret & coded & (F.ascii(last) > 127)
        ch = F.when(plain | beyond, last).otherwise(_glyph(byte))
        return F.struct(ch.alias("ch"), F.when(plain, "w").when(beyond, "b").otherwise(_color(byte)).alias("color"))

    return F.transform(F.regexp_extract_all(name, F.lit(_CODE), F.lit(1)), one)


def byte_codes(name: Column) -> Column:
    """The characters of a name of game characters (0 to 255), as ``ch`` and ``color``: b for brown ones, g for gold ones, else null.

    Brackets and digits of the low characters are gold, whether their high bit is set or not; other low ones are ``_`` without colour.
    """

    def one(ch: Column) -> Column:
        raw = F.ascii(ch)
        low = F.when(raw >= 128, raw - 128).otherwise(raw)
        shown = F.when((low < 16) | low.between(29, 31), "_").when(low == 28, "•").when(low < 28, F.substring(F.lit(GLYPHS), (low + 1).cast("int"), F.lit(1))).otherwise(F.when(raw < 256, F.chr(low)).otherwise(ch))
        color = F.when(low.between(16, 27), "g").when((raw >= 160) & (raw < 256), "b")
        return F.struct(shown.alias("ch"), color.alias("color"))

    return F.transform(F.filter(F.split(name, ""), lambda c: c != ""), one)


def painted(name: Column, colors: Column) -> Column:
    """The characters of a plain name with the colours of another text, one letter each; w where it is too short."""
    chars = F.filter(F.split(name, ""), lambda c: c != "")
    return F.transform(chars, lambda c, i: F.struct(c.alias("ch"), F.coalesce(F.nullif(F.substring(colors, (i + 1).cast("int"), F.lit(1)), F.lit("")), F.lit("w")).alias("color")))


def runs(chars: Column) -> Column:
    """``text`` and ``color`` of the longest stretches of one colour, in order."""
    run = "struct<text:string,color:string>"

    def longer(done: Column, c: Column) -> Column:
        last, ch = F.get(done, F.size(done) - 1), F.coalesce(c["ch"], F.lit(""))
        joins = (F.size(done) > 0) & last["color"].eqNullSafe(c["color"])
        grown = F.struct(F.concat(F.when(joins, last["text"]).otherwise(""), ch).alias("text"), c["color"].alias("color")).cast(run)
        return F.concat(F.when(joins, F.slice(done, 1, F.size(done) - 1)).otherwise(done), F.array(grown))

    # one pass: each mention of chars would make them anew
    return F.aggregate(chars, F.array().cast(f"array<{run}>"), longer)


def markup(chars: Column, css: str = "color-") -> Column:
    """The characters as HTML, each run of a colour in a span of a class of its name; runs without a colour stand alone."""

    def one(run: Column) -> Column:
        text = run["text"]
        for plain, coded in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            text = F.replace(text, F.lit(plain), F.lit(coded))
        return F.when(run["color"].isNull(), text).otherwise(F.concat(F.lit(f'<span class="{css}'), run["color"], F.lit('">'), text, F.lit("</span>")))

    return F.array_join(F.transform(runs(chars), one), "")
