"""Text of PDF files: pages in their order, and the strings that their content streams show.

What is read: plain and Flate streams, object streams, page trees with inherited resources, and
fonts with a ToUnicode map; strings of other fonts are taken as Latin-1. Text moves to a new
line where the page does. Encrypted files, images and other filters have no text.
"""

from __future__ import annotations

import re
import zlib

_OBJECT = re.compile(rb"(?<![0-9])(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_REF = re.compile(rb"(\d+)\s+\d+\s+R\b")
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.|\([^()]*\))*\))*\)|<<|>>|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s()<>\[\]/%]+|[^\s()<>\[\]/%]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Document:
    """The objects of a file by number."""

    def __init__(self, data: bytes):
        if not data.lstrip()[:5] == b"%PDF-":
            raise ValueError("no PDF file")
        self.objects = {int(m[1]): m[3] for m in _OBJECT.finditer(data)}
        for body in list(self.objects.values()):
            if b"/ObjStm" in body.split(b"stream", 1)[0]:
                self._unpack(body)

    def _unpack(self, body: bytes) -> None:
        """Objects that are packed in a stream: pairs of numbers and offsets, and then the objects."""
        data = self.stream(body)
        first, count = (int(re.search(rb"/" + k + rb"\s+(\d+)", body)[1]) for k in (b"First", b"N"))
        head = [int(x) for x in data[:first].split()[: 2 * count]]
        ends = [*head[3::2], len(data) - first]
        for number, start, end in zip(head[::2], head[1::2], ends):
            self.objects.setdefault(number, data[first + start : first + end])

    def stream(self, body: bytes) -> bytes:
        found = _STREAM.search(body)
        if not found:
            return b""
        head, raw = body[: found.start()], found[1]
        if b"/FlateDecode" in head or re.search(rb"/Filter\s*\[?\s*/Fl\b", head):
            return zlib.decompressobj().decompress(body[found.start(1) :])
        return b"" if b"/Filter" in head else raw

    def refs(self, body: bytes, key: bytes) -> list[int]:
        """The objects that a key of a dictionary names, one or a list."""
        found = re.search(rb"/" + key + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
        return [int(x) for x in _REF.findall(found[1])] if found else []

    def pages(self) -> list[tuple[bytes, bytes]]:
        """(page, resources) in the order of the page tree."""
        roots = [n for b in self.objects.values() if re.search(rb"/Type\s*/Catalog\b", b) for n in self.refs(b, b"Pages")]
        out, seen = [], set()

        def walk(number: int, inherited: bytes) -> None:
            body = self.objects.get(number, b"")
            if number in seen:
                return
            seen.add(number)
            own = self.part(body, b"Resources") or inherited
            kids = self.refs(body, b"Kids")
            if not kids and re.search(rb"/Type\s*/Page\b", body):
                out.append((body, own))
            for kid in kids:
                walk(kid, own)

        for root in roots:
            walk(root, b"")
        return out

    def part(self, body: bytes, key: bytes) -> bytes:
        """A dictionary under a key: another object, or what stands there."""
        at = re.search(rb"/" + key + rb"\s*", body)
        if not at:
            return b""
        rest = body[at.end() :]
        if ref := re.match(rb"(\d+)\s+\d+\s+R\b", rest):
            return self.objects.get(int(ref[1]), b"")
        depth = 0
        for m in re.finditer(rb"<<|>>", rest):
            depth += 1 if m[0] == b"<<" else -1
            if depth == 0:
                return rest[: m.end()]
        return b""

    def fonts(self, resources: bytes) -> dict[bytes, tuple[int, dict[int, str]]]:
        """Of each font with a map: the bytes of a code, and the text of each code."""
        out = {}
        for name, number in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", self.part(resources, b"Font")):
            for ref in self.refs(self.objects.get(int(number), b""), b"ToUnicode"):
                out[name] = unicode_map(self.stream(self.objects.get(ref, b"")))
        return out


def unicode_map(data: bytes) -> tuple[int, dict[int, str]]:
    text = lambda x: bytes.fromhex(x.decode()).decode("utf-16-be", "replace")
    codes, size = {}, 1
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", data, re.S):
        for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            codes[int(a, 16)], size = text(b), len(a) // 2
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", data, re.S):
        for a, z, b, many in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[([^\]]*)\])", block):
            low, high, size = int(a, 16), min(int(z, 16), int(a, 16) + 65535), len(a) // 2
            listed = [text(x) for x in re.findall(rb"<([0-9A-Fa-f]+)>", many)]
            for i, code in enumerate(range(low, high + 1)):
                if b:
                    first = text(b)
                    codes[code] = first[:-1] + chr(ord(first[-1]) + i)
                elif i < len(listed):
                    codes[code] = listed[i]
    return size, codes


def _literal(token: bytes) -> bytes:
    """The bytes of a string in brackets or in hexadecimal digits."""
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())

    def one(m) -> bytes:
        x = m[1]
        if x[:1].isdigit():
            return bytes([int(x, 8) & 255])
        return b"" if x in (b"\n", b"\r\n", b"\r") else _ESCAPES.get(x, x)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", one, token[1:-1], flags=re.S)


def shown(content: bytes, fonts: dict[bytes, tuple[int, dict[int, str]]]) -> str:
    """The text that a content stream shows."""
    out: list[str] = []
    stack: list[bytes] = []
    font: tuple[int, dict[int, str]] | None = None

    def put(token: bytes) -> None:
        raw = _literal(token)
        if font:
            size, codes = font
            out.append("".join(codes.get(int.from_bytes(raw[i : i + size], "big"), "") for i in range(0, len(raw), size)))
        else:
            out.append(raw.decode("latin-1"))

    def line() -> None:
        if out and not out[-1].endswith("\n"):
            out.append("\n")

    for m in _TOKEN.finditer(content):
        token = m[0]
        if token[:1] in b"(</[]" or token in (b">>", b"<<") or re.fullmatch(rb"[+-]?\d*\.?\d*", token):
            stack.append(token)
            continue
        if token == b"Tf" and len(stack) > 1:
            font = fonts.get(stack[-2][1:])
        elif token == b"Tj" and stack:
            put(stack[-1])
        elif token in (b"'", b'"') and stack:
            line()
            put(stack[-1])
        elif token == b"TJ":
            for x in stack[len(stack) - 1 - stack[::-1].index(b"[") if b"[" in stack else 0 :]:
                if x[:1] in (b"(", b"<"):
                    put(x)
                elif re.fullmatch(rb"-\d+\.?\d*", x) and float(x) < -200 and out and not out[-1].endswith((" ", "\n")):
                    out.append(" ")  # a gap as wide as a space
        elif token == b"T*" or (token in (b"Td", b"TD") and len(stack) > 1 and float(stack[-1] or 0) != 0) or token in (b"Tm", b"ET"):
            line()
        stack = []
    return "".join(out).strip()


def pages(data: bytes) -> list[str]:
    """The text of each page of a PDF file."""
    doc = Document(data)
    out = []
    for body, resources in doc.pages():
        content = b"\n".join(doc.stream(doc.objects.get(n, b"")) for n in doc.refs(body, b"Contents"))
        out.append(shown(content, doc.fonts(resources)))
    return out
