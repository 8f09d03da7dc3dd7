"""Text helpers: whitespace, entities, charset, file paths and the patterns of book lines."""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallybook.model import ACCOUNT_ROOTS

_SPACE = " \t\r\n"


def strip(text: Column) -> Column:
    """Without leading and trailing whitespace."""
    return F.btrim(text, F.lit(_SPACE))


# Entities of statement text. "&amp;" comes last, so that "&amp;lt;"
# gives "&lt;".
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&"))


def expand_entities(text: Column) -> Column:
    for entity, character in _ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(character))
    return text


# The Windows-1252 characters of bytes 0x80-0x9F. Everywhere else the code page
# equals ISO-8859-1; the five bytes it leaves open stay as they are.
_HIGH_BYTES = [
    (chr(byte), bytes([byte]).decode("cp1252", errors="ignore")) for byte in range(0x80, 0xA0)
]
_FROM_LATIN1 = "".join(latin for latin, windows in _HIGH_BYTES if windows)
_TO_WINDOWS = "".join(windows for _, windows in _HIGH_BYTES if windows)


def decode_windows_1252(raw: Column) -> Column:
    """Text of a column whose bytes are Windows-1252, whatever its declared type.

    Goes by way of ISO-8859-1, which maps every byte to one character and needs no
    legacy charset setting.
    """
    return F.translate(F.decode(raw.cast("binary"), "ISO-8859-1"), _FROM_LATIN1, _TO_WINDOWS)


def resolve_path(including: str, path: str) -> str:
    """``path`` as written in the file ``including``; relative ones start at its folder.

    ``including`` may be a URI; the result keeps its scheme and authority.
    """
    scheme, rest = re.fullmatch(r"((?:[a-zA-Z][\w+.-]*:)?(?://[^/]*)?)(/.*)", including).groups()
    if re.match(r"[a-zA-Z][\w+.-]*:/", path):
        return re.sub(r"^file:/+", "file:/", path)
    return scheme + posixpath.normpath(posixpath.join(posixpath.dirname(rest), path))


# --- lines of a book ---

_GAP = "[ \\t]+"
_DATE = r"(\d{4}-\d{2}-\d{2})"
_ACCOUNT = r"((?:" + "|".join(ACCOUNT_ROOTS) + r")(?::[\p{IsAlphabetic}\p{N}-]+)+)"
# The raw type holds ten decimals; more are a fault, not rounded.
_NUMBER = r"(-?\d{1,28}(?:\.\d{1,10}0*)?)"
_COMMODITY = "([A-Z0-9_]+)"
_QUOTED = '"([^"]+)"'
_AMOUNT = f"{_GAP}{_NUMBER}{_GAP}{_COMMODITY}"

#: Fields of each group of statements, for lines known to be one of them.
VERIFICATION = f"^{_DATE}{_GAP}(?:open|close|balance){_GAP}{_ACCOUNT}(?:{_AMOUNT})?"
HEADER = f"^{_DATE}{_GAP}\\*{_GAP}{_QUOTED}(?:{_GAP}(#[A-Za-z0-9]+(?: #[A-Za-z0-9]+)*))?"
POSTING = f"^ {{2}}{_ACCOUNT}(?:{_AMOUNT})?(?:{_GAP}@@{_AMOUNT})?"
INCLUDE = f"^include{_GAP}{_QUOTED}"
TWO_QUOTED = f"{_QUOTED}{_GAP}{_QUOTED}"
CUSTOM = f"^{_DATE}{_GAP}custom(.*)"

#: The word that names an unindented statement; the date before it is optional here.
STATEMENT_WORD = (
    r"^(?:\d{4}-\d{2}-\d{2}[ \t]+)?(open|close|balance|event|custom|\*|include|option)"
)

#: Any statement, from the start of the line to its own end.
STATEMENT = (
    f"^(?:{_DATE}{_GAP}(?:(?:open|close){_GAP}{_ACCOUNT}"
    f"|balance{_GAP}{_ACCOUNT}{_AMOUNT}"
    f"|\\*{_GAP}{_QUOTED}(?:{_GAP}#[A-Za-z0-9]+(?: #[A-Za-z0-9]+)*)?"
    f"|event{_GAP}{TWO_QUOTED}"
    f"|custom.*)"
    f"|include{_GAP}{_QUOTED}"
    f"|option{_GAP}{TWO_QUOTED}"
    f"|{POSTING[1:]})"
)

#: What may follow a statement on its line.
LINE_END = "[ \\t]*(?:;.*)?$"

#: A line that ends inside the first or second quoted text of its statement.
TEXT_OPENS = (
    f"^(?:{_DATE}{_GAP}\\*{_GAP}|include{_GAP}|(?:{_DATE}{_GAP}event|option){_GAP}(?:{_QUOTED}{_GAP})?)"
    '"[^"]*$'
)
#: A header that does so.
HEADER_OPENS = f"^{_DATE}{_GAP}\\*"
#: What a line does to a text that is open before it: it ends the statement, holds the whole second
#: text, or opens that.
TEXT_ENDS = f'^[^"]*"(?:{_GAP}#[A-Za-z0-9]+(?: #[A-Za-z0-9]+)*)?{LINE_END}'
TEXT_SECOND = f'^[^"]*"{_GAP}{_QUOTED}{LINE_END}'
TEXT_AGAIN = f'^[^"]*"{_GAP}"[^"]*$'
