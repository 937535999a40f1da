"""Places of elements in the text of an XML part, so that an edit rewrites what it changes and leaves all else as it is."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from xml.dom import minidom
from xml.etree import ElementTree

from .packages import Package, Refused, check_xml, _tree

TOKEN = re.compile(r"""<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<(/?)((?:[^\s/<>]+:)?([^\s/<>:]+))((?:[^<>"']|"[^"]*"|'[^']*')*?)(/?)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=]+)\s*=\s*(?:"([^"]*)"|'([^']*)')""")


def named(text: str) -> dict[str, str]:
    """The attributes in a tag, as they are written."""
    return {m[1]: m[2] if m[2] is not None else m[3] for m in _ATTRIBUTE.finditer(text)}


def tag(name: str, attributes: dict[str, str], alone: bool) -> str:
    return f"<{name}{''.join(f' {k}="{v.replace('"', "&quot;")}"' for k, v in attributes.items())}{'/' * alone}>"


def text_of_part(package: Package, part: str) -> str:
    """The text of a part that is well-formed UTF-8 without a document type; other parts are refused."""
    data = package.read(part)
    check_xml(data)
    return _decoded(data)


def text_and_tree(package: Package, part: str) -> tuple[str, ElementTree.Element]:
    """As text_of_part, and the tree of the part, which is read once for both."""
    data = package.read(part)
    root = _tree(data)
    return _decoded(data), root


def _decoded(data: bytes) -> str:
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        raise Refused("ENCODING_UNSUPPORTED") from None


def spliced(text: str, pieces: list[tuple[int, int, str]]) -> str:
    """The text with parts of it replaced; pieces (start, stop, new) do not overlap."""
    out, at = [], 0
    for start, stop, new in sorted(pieces):
        out += [text[at:start], new]
        at = stop
    return "".join([*out, text[at:]])


@dataclass(slots=True)
class Place:
    """An element in the text: its local name, its path by names and numbers among equals, where it stands (start, end of
    the opening tag, stop), and the number of its container in the list."""

    name: str
    path: str
    start: int
    opened: int
    stop: int
    inside: int


#: What keeps a part from being plain: comments and the like, and end tags with space in them.
_ODD = re.compile(r"<!|<\?(?!xml\s)|</[^<>\s]*\s")
#: Elements that readers look for, also inside of a paragraph.
_HOLDER = re.compile(r"<(?:[^\s/<>:]+:)?(?:p|tbl|sdt)[\s/>]")
_PLAIN_ROOT = re.compile(r"""\s*(?:<\?xml[^<>]*\?>\s*)?<w:\w+((?:\s+[\w:.-]+=(?:"[^"<]*"|'[^'<]*'))*)\s*>""")


def is_plain(text: str, namespace: str) -> bool:
    """Whether a part has no comments and the like, and the prefix w, and no other one, for a namespace throughout."""
    head = _PLAIN_ROOT.match(text)
    return head is not None and f'xmlns:w="{namespace}"' in head[1] and text.count(namespace) == 1 and text.find("xmlns", head.end()) < 0 and not _ODD.search(text)


def places(text: str, wanted, leaves: int | None = None) -> list[Place]:
    """The elements for which wanted(name, depth) holds and all that they stand in, in the order of the text. Paths are
    like /w:document/w:body/w:p[2], with the first two levels unnumbered. leaves is a depth from which on nothing is wanted
    inside of a paragraph but paragraphs, tables and content controls: paragraphs without these are passed over at once."""
    found: list[Place] = []
    stack: list[tuple[Place | None, dict[str, int], str, int]] = []
    if leaves is not None and _ODD.search(text):
        leaves = None
    at = 0
    while (m := TOKEN.search(text, at)) is not None:
        at = m.end()
        if m[2] is None:
            continue
        name, closing, alone = m[3], bool(m[1]), bool(m[5])
        if closing:
            place = stack.pop()[0]
            if place is not None:
                place.stop = m.end()
            continue
        path, inside = "", -1
        if stack:
            _, counts, path, inside = stack[-1]
            counts[name] = counts.get(name, 0) + 1
            path = f"{path}/w:{name}" + (f"[{counts[name]}]" if len(stack) > 1 else "")
        else:
            path = f"/w:{name}"
        place = None
        if wanted(name, len(stack)):
            place = Place(name, path, m.start(), m.end(), m.end(), inside)
            found.append(place)
        if leaves is not None and name == "p" and not alone and len(stack) >= leaves:
            end = f"</{m[2]}>"
            stop = text.find(end, at)
            if stop >= 0 and not _HOLDER.search(text, at, stop):
                at = stop + len(end)
                if place is not None:
                    place.stop = at
                    if len(stack) > 1:
                        at = _alike(text, at, m[0], end, found, *stack[-1][1:])
                continue
        if not alone:
            stack.append((place, {}, path, len(found) - 1 if place is not None else inside))
    return found


def _alike(text: str, at: int, opening: str, end: str, found: list[Place], counts: dict[str, int], path: str, inside: int) -> int:
    """Adds the numbered paragraphs that follow one another from a place on, begin with the same tag and hold no others; they
    are wanted as the one before them is. Gives the place behind them."""
    size = len(opening)
    while text.startswith(opening, at):
        stop = text.find(end, at + size)
        if stop < 0 or _HOLDER.search(text, at + size, stop):
            break
        counts["p"] += 1
        found.append(Place("p", f"{path}/w:p[{counts['p']}]", at, at + size, stop + len(end), inside))
        at = stop + len(end)
    return at


def declarations(text: str) -> str:
    """The namespace declarations of a part's root."""
    root = next(m for m in TOKEN.finditer(text) if m[2] is not None)
    return " ".join(f'{k}="{v}"' for k, v in named(root[4]).items() if k == "xmlns" or k.startswith("xmlns:"))


class Fragment:
    """Some elements of a part as a tree, with the namespaces that the part declares. follows: a paragraph stands before
    them, which the root then tells by an attribute."""

    def __init__(self, spaces: str, xml: str, follows: bool = False):
        self.document = minidom.parseString(f"<fragment {spaces}>{xml}</fragment>")
        self.root = self.document.documentElement
        if follows:
            self.root.setAttribute("follows", "p")

    def text(self) -> str:
        return "".join(n.toxml() for n in self.root.childNodes).replace("\r", "&#13;")  # else it is read as a line feed


def into_root(xml: str, made) -> str:
    """The XML of a part with made(prefix of the root) put last into its root."""
    spot = None
    for m in TOKEN.finditer(xml):
        if m[2] is not None:
            spot = m
    if spot is None:
        raise Refused("PART_UNEXPECTED")
    new = made(spot[2][: -len(spot[3])])
    if spot[5]:  # the root is empty
        return f"{xml[: spot.start()]}<{spot[2]}{spot[4]}>{new}</{spot[2]}>{xml[spot.end() :]}"
    return f"{xml[: spot.start()]}{new}{xml[spot.start() :]}"


def appended(xml: str, element: str) -> str:
    """The XML of a part with an empty element put last into its root, in the root's prefix."""
    return into_root(xml, lambda prefix: f"<{prefix}{element}/>")


def elements(node) -> Iterator:
    return (c for c in node.childNodes if c.nodeType == c.ELEMENT_NODE)


def related(package: Package, rels: str, kind: str, target: str, part: str, content_type: str) -> dict[str, bytes | None]:
    """The parts that tell of a new part: its content type, and a relationship to it under an id that is not taken."""
    types, known = text_of_part(package, "[Content_Types].xml"), text_of_part(package, rels) if rels in package.names else None
    known = known or '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"></Relationships>'
    taken = set(re.findall(r"""\bId=["']([^"']*)["']""", known))
    own = next(f"rId{k}" for k in range(1, len(taken) + 2) if f"rId{k}" not in taken)
    return {
        "[Content_Types].xml": appended(types, f'Override PartName="/{part}" ContentType="{content_type}"').encode(),
        rels: appended(known, f'Relationship Id="{own}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/{kind}" Target="{target}"').encode(),
    }
