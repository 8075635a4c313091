"""Entries of one feed document, read in a single pass that forgives bad markup."""

from __future__ import annotations

import re
from collections.abc import Iterator

# What markup begins with; all between two matches is text, and so is a "<" that begins none of it. The
# "<" stands before all alternatives, so that the engine looks for that character alone.
TOKEN = re.compile(
    r"""<(?:(?P<comment>!--.*?(?:-->|\Z))
    |!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)
    |(?P<other>\?.*?(?:\?>|\Z)|![A-Za-z][^<>]*>)
    |(?P<end>/?)(?P<name>[A-Za-z_][\w:.-]*)
      (?P<rest>[^<>"']*(?:"[^"<]*"[^<>"']*|'[^'<]*'[^<>"']*)*)>)""",
    re.DOTALL | re.VERBOSE,
)
ATTRIBUTE = re.compile(r"""([\w:.-]+)\s*=\s*(?:"([^"]*)"|'([^']*)')""")
REFERENCE = re.compile(r"&(?:(amp|lt|gt|quot|apos)|#([0-9]{1,7})|#[xX]([0-9A-Fa-f]{1,6}));")
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
ENTRY_NAMES = ("item", "entry")
# What may cut an entry off before its end tag.
DOCUMENT_ENDS, NEXT_BEGINS, HOLDER_ENDS = "document ends", "next entry begins", "holder ends"
EDGES = " \t\r\n"


def decoded(text: str) -> str:
    """Text with the references of XML replaced; those of HTML stay, as does a bare ampersand."""
    return REFERENCE.sub(_referred, text) if "&" in text else text


def _referred(found: re.Match) -> str:
    name, number, hexadecimal = found.groups()
    if name:
        return NAMED[name]
    point = int(number) if number else int(hexadecimal, 16)
    legal = 0 < point < 0xD800 or 0xDFFF < point < 0x110000
    return chr(point) if legal else found[0]


class Entry:
    """An item or entry that has begun: what its own children say.

    The elements that are open inside it form a stack. Only the lowest one is a field; markup below
    that is kept as it stands, as part of the field's text.
    """

    def __init__(self, name: str):
        self.name = name
        self.prefix = name.rpartition(":")[0]
        self.open: list[str] = []
        self.pieces: list[tuple[str, bool]] = []
        self.marked = False
        self.attributes: dict[str, str] = {}
        self.fields: dict[str, str] = {}
        self.links: list[tuple[str, dict[str, str]]] = []

    def start(self, name: str, rest: str, source: str) -> None:
        closed = rest.endswith("/")
        if self.open:
            self.marked = True
            self.pieces.append((source, True))
            if not closed:
                self.open.append(name)
            return
        found = ATTRIBUTE.finditer(rest) if "=" in rest else ()
        self.attributes = {one[1].lower(): decoded(one[2] if one[2] is not None else one[3]) for one in found}
        self.pieces, self.marked = [], False
        self.open = [name]
        if closed:
            self.end(name, "")

    def text(self, text: str, literal: bool) -> None:
        if self.open and text:
            self.pieces.append((text, literal))

    def end(self, name: str, source: str) -> None:
        """Closes the nearest element of that name and all inside it; without one it says nothing."""
        if name not in self.open:
            return
        while self.open[-1] != name:
            self.open.pop()
        self.open.pop()
        if self.open:
            self.pieces.append((source, True))
            return
        # Inside a field with markup, text is markup too, and its references are for whoever reads that.
        text = "".join(piece if literal or self.marked else decoded(piece) for piece, literal in self.pieces).strip(EDGES)
        field = self.key(name)
        if field == "link":
            self.links.append((text, self.attributes))
        elif field == "guid":
            self.fields.setdefault(field, text if self.attributes.get("ispermalink", "").lower() != "false" else "")
        else:
            self.fields.setdefault(field, text)

    def key(self, name: str) -> str:
        """The name without the entry's own prefix, in lower case, other prefixes set off by "_"."""
        prefix, _, local = name.rpartition(":")
        return (local if prefix == self.prefix else f"{prefix}_{local}").lower()

    def link(self) -> str | None:
        """The link given as text, else the alternate address, else the first one, else a permanent
        identifier."""
        told = [text for text, _ in self.links if text]
        named = [own for _, own in self.links if "href" in own]
        alternate = [own["href"] for own in named if own.get("rel", "alternate") == "alternate"]
        found = told or alternate or [own["href"] for own in named] or [self.fields.get("guid") or None]
        return found[0]


def scan(document: str) -> Iterator[Entry | str]:
    """Every item or entry of a document in its order; a text stands for one that is cut off and says by
    what: the end of the document or of what holds it, or the next one.

    Comments, instructions and CDATA are known wherever they stand, so what looks like markup in them
    begins nothing. End tags without a start are passed over, elements left open end with what holds
    them, and a "<" that begins no tag is text. An entry without content (``<item/>``) is none.
    """
    entry, holders, place = None, [], 0
    for token in TOKEN.finditer(document):
        if entry:
            entry.text(document[place : token.start()], False)
        place = token.end()
        name = token["name"]
        if name is None:
            if entry and token["data"] is not None:
                entry.text(token["data"], True)
        elif not token["end"]:
            begins = name.rpartition(":")[2].lower() in ENTRY_NAMES and not token["rest"].endswith("/")
            if entry and not (begins and name == entry.name):
                entry.start(name, token["rest"], token[0])
            elif begins:
                if entry:
                    yield NEXT_BEGINS
                entry = Entry(name)
            elif not token["rest"].endswith("/"):
                holders.append(name)
        elif not entry:
            if name in holders:
                del holders[len(holders) - 1 - holders[::-1].index(name) :]
        elif name == entry.name:
            yield entry
            entry = None
        elif name in holders and name not in entry.open:
            yield HOLDER_ENDS
            entry = None
        else:
            entry.end(name, token[0])
    if entry:
        yield DOCUMENT_ENDS
