"""Request spelling, byte by byte, with Spark's own functions.

Bytes are looked at as characters of the same number. A byte that came from a percent escape is kept apart as a character
of the private range from U+E000 on, so that one pattern can ask both what a byte is and whether it was written out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailwork.functions.network import let

LONG_TARGET = 8192
_PLAIN = "".join(map(chr, range(256)))
_CODED = "".join(chr(0xE000 + i) for i in range(256))
_HEX = "0-9A-Fa-f"


def _set(*ranges: str, coded: bool | None = None) -> str:
    """A pattern's class of bytes, given as ranges of hexadecimal numbers: as they came, from escapes, or (None) either."""
    out = ""
    for r in ranges:
        low, _, high = r.partition("-")
        for base in (0x0000,) * (coded is not True) + (0xE000,) * (coded is not False):
            out += f"\\u{base + int(low, 16):04x}-\\u{base + int(high or low, 16):04x}"
    return f"[{out}]"


def _word(*numbers: int) -> str:
    return "".join(_set(f"{n:x}") for n in numbers)


_DIGIT = _set("30-39", "41-46", "61-66")
_PERCENT = _set("25")
_TAIL = _set("80-bf")
#: Non-shortest UTF-8 spellings of the dot (one of them an old one that ends in a plain dot) and of the separators.
_LONG_DOTS = [_word(0xC0, 0xAE), _word(0xE0, 0x80, 0xAE), _word(0xF0, 0x80, 0x80, 0xAE), _word(0xC0, 0x2E)]
_LONG_SEPARATORS = [_word(0xC0, 0xAF), _word(0xC1, 0x9C), _word(0xE0, 0x80, 0xAF), _word(0xE0, 0x81, 0x9C), _word(0xF0, 0x80, 0x80, 0xAF)]
_ANY_DOT, _ANY_SEPARATOR = f"(?:{'|'.join([_set('2e'), *_LONG_DOTS])})", f"(?:{'|'.join([_set('2f', '5c'), *_LONG_SEPARATORS])})"
_LONG_DOT, _LONG_SEPARATOR = f"(?:{'|'.join(_LONG_DOTS)})", f"(?:{'|'.join(_LONG_SEPARATORS)})"
#: Code points that %u escapes spell besides ASCII: full-width and mathematical look-alikes of dot and separators.
_LOOK_ALIKES = ["ff0e", "ff0f", "ff3c", "2215", "2216"]

#: Patterns of the bytes as they came.
_RAW = {
    "double-encoding": f"%25[{_HEX}]{{2}}",
    "iis-unicode": f"%[uU][{_HEX}]{{4}}",
    "iis-unicode-ascii": f"(?i)%u(?:00[0-7][0-9a-f]|{'|'.join(_LOOK_ALIKES)})",
    "invalid-percent-escape": f"%(?![{_HEX}]{{2}})",
}
#: Patterns of the bytes as they came, decoded once and decoded twice.
_STAGES = {
    "nul-byte": _set("0"),
    "crlf": _set("d", "a"),
    "control-char": _set("1-9", "b-c", "e-1f", "7f"),
    "overlong-utf8": f"{_set('c0-c1')}{_TAIL}|{_set('e0')}{_set('80-9f')}{_TAIL}|{_set('f0')}{_set('80-8f')}{_TAIL}{{2}}",
}
#: Patterns of the decoded bytes: two dots and a separator, one of the three at least not in its shortest form.
_OVERLONG_TRAVERSAL = f"{_LONG_DOT}{_ANY_DOT}{_ANY_SEPARATOR}|{_ANY_DOT}{_LONG_DOT}{_ANY_SEPARATOR}|{_ANY_DOT}{_ANY_DOT}{_LONG_SEPARATOR}"
_UTF8 = "|".join([
    _set("0-7f"), _set("c2-df") + _TAIL, _set("e0") + _set("a0-bf") + _TAIL, _set("e1-ec", "ee-ef") + _TAIL + "{2}", _set("ed") + _set("80-9f") + _TAIL,
    _set("f0") + _set("90-bf") + _TAIL + "{2}", _set("f1-f3") + _TAIL + "{3}", _set("f4") + _set("80-8f") + _TAIL + "{2}",
])
_EDGE, _DOT = _set("2f", "5c"), _set("2e")
_CODED_EDGE, _CODED_DOT = _set("2f", "5c", coded=True), _set("2e", coded=True)
_PLAIN_EDGE, _PLAIN_DOT = _set("2f", "5c", coded=False), _set("2e", coded=False)
#: Patterns of the path at each stage: a segment of two dots, with or without an escape in it or at its borders.
_SEGMENTS = {
    "traversal": f"(?:^|{_PLAIN_EDGE}){_PLAIN_DOT}{{2}}(?={_PLAIN_EDGE}|$)",
    "traversal-encoded": f"(?:^|{_EDGE})(?:{_CODED_DOT}{_DOT}|{_DOT}{_CODED_DOT})(?={_EDGE}|$)|{_CODED_EDGE}{_DOT}{{2}}(?={_EDGE}|$)|(?:^|{_EDGE}){_DOT}{{2}}(?={_CODED_EDGE})",
    "path-parameter-traversal": f"(?:^|{_EDGE}){_DOT}{{2}}{_set('3b')}",
    "backslash-path": _set("5c"),
}


def decoded(text: Column) -> Column:
    """One pass of percent decoding; bad escapes and + stay."""
    pieces = F.regexp_extract_all(text, F.lit(f"(?s){_PERCENT}{_DIGIT}{{2}}|(?:(?!{_PERCENT}).)++|."), F.lit(0))
    digits = lambda p: F.translate(F.substring(p, 2, 2), _CODED, _PLAIN)
    byte = lambda p: F.decode(F.unhex(F.concat(F.lit("E0"), digits(p))), "UTF-16BE")
    return F.array_join(F.transform(pieces, lambda p: F.when((F.length(p) == 3) & p.rlike(f"^{_PERCENT}{_DIGIT}{{2}}$"), byte(p)).otherwise(p)), "")


def features(path: Column, query: Column, request_line: Column | None = None, most: int = LONG_TARGET) -> Column:
    """Sorted (feature, part) of a request target: path and query, and the request line where it is known.

    A NULL path or query has no features of its own. Only targets with a suspicious character are looked at.
    """
    found = lambda holds, name, part: F.when(F.coalesce(holds, F.lit(False)), F.struct(F.lit(name).alias("feature"), F.lit(part).alias("part")))
    out: list[Column] = []
    for part, text in (("path", path), ("query", query)):

        def marks(stages: Column) -> Column:  # used within this turn of the loop
            raw = F.get(stages, F.lit(0))
            some = lambda pattern: F.exists(stages, lambda s: s.rlike(pattern))
            last = lambda pattern: F.exists(F.slice(stages, 2, 2), lambda s: s.rlike(pattern))
            named = [found(raw.rlike(rule), name, part) for name, rule in _RAW.items()] + [found(some(rule), name, part) for name, rule in _STAGES.items()]
            named += [found(last(_OVERLONG_TRAVERSAL), "overlong-traversal", part), found(~F.element_at(stages, 3).rlike(f"^(?:{_UTF8})*+$"), "invalid-utf8", part)]
            named += [found(some(rule), name, part) for name, rule in _SEGMENTS.items()] if part == "path" else []
            return F.array_compact(F.array(*named))

        raw = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
        stages = let(raw, lambda r: let(decoded(r), lambda once: F.array(r, once, decoded(once))))
        odd = text.rlike(r"[%\\\x00-\x1f\x7f]|\.\.")
        out.append(F.when(odd, let(stages, marks)))
    target = [found(F.octet_length(path) + F.coalesce(F.octet_length(query) + 1, F.lit(0)) > most, "long-target", "target")]
    if request_line is not None:
        words = F.filter(F.split(request_line, r"[ \t\n\f\r]"), lambda w: w != "")
        word = lambda i: F.get(words, F.lit(i))
        empty = (F.size(words) == 0) | ((F.size(words) == 1) & (word(0) == "-"))
        absolute, authority, asterisk = word(1).rlike("(?i)^https?://"), (word(0) == "CONNECT") & word(1).contains(":"), word(1) == "*"
        http = (F.size(words) == 3) & word(2).startswith("HTTP/") & ~request_line.rlike(r"[^\x20-\x7e]")
        known = F.coalesce(absolute | authority | asterisk | word(1).startswith("/"), F.lit(True))
        target += [found(empty, "empty-request", "request-line"), found(~empty & ~(http & known), "non-http-request-line", "request-line")]
        target += [found(~empty & absolute, "absolute-form", "request-line"), found(~empty & ~absolute & authority, "authority-form", "request-line"), found(~empty & ~absolute & ~authority & asterisk, "asterisk-form", "request-line")]
    else:
        target += [found(path == "*", "asterisk-form", "target"), found(path.rlike("(?i)^https?://"), "absolute-form", "target"), found(path.rlike("^[^/]+:[0-9]+$"), "authority-form", "target")]
    none = F.array().cast("array<struct<feature:string,part:string>>")
    return F.array_sort(F.concat(*[F.coalesce(x, none) for x in out], F.array_compact(F.array(*target))))

