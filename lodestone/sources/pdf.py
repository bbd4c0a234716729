"""Text of PDF files, from the published file format; no library is assumed."""

from __future__ import annotations

import re
import zlib

_OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b")
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<<|>>|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s<>\[\]()/%]*|[^\s<>\[\]()/%]+|%[^\r\n]*", re.S)
_ESCAPE = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def literal(token: bytes) -> bytes:
    """Bytes of a string token, (literal) or <hex>."""
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode("ascii"))

    def put(m: re.Match) -> bytes:
        x = m[1]
        if x[:1].isdigit():
            return bytes([int(x, 8) & 255])
        return b"" if x in (b"\n", b"\r\n", b"\r") else _ESCAPE.get(x, x)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", put, token[1:-1], flags=re.S)


def inflate(data: bytes, most: int = 80 << 20) -> bytes:
    for bits in (15, -15):
        try:
            return zlib.decompressobj(bits).decompress(data, most)
        except zlib.error:
            continue
    return b""


class Pdf:
    """Objects of a file: number -> (dictionary part, raw stream or None)."""

    def __init__(self, data: bytes):
        self.objects: dict[int, tuple[bytes, bytes | None]] = {}
        found = [*_OBJECT.finditer(data)]
        for m, after in zip(found, [*found[1:], None]):
            body = data[m.end() : after.start() if after else len(data)]
            start = re.search(rb"stream\r?\n", body)
            if start:
                head = body[: start.start()]
                size = re.search(rb"/Length\s+(\d+)(?!\s+\d+\s+R)", head)
                raw = body[start.end() :]
                end = raw.rfind(b"endstream")
                raw = raw[: int(size[1])] if size and int(size[1]) <= len(raw) else raw[: end if end >= 0 else len(raw)]
                self.objects[int(m[1])] = (head, raw)
            else:
                self.objects[int(m[1])] = (body.split(b"endobj")[0], None)
        for n in [*self.objects]:  # objects packed into streams
            head, raw = self.objects[n]
            if raw is not None and b"/ObjStm" in head:
                self._unpack(head, self.stream(n))

    def _unpack(self, head: bytes, data: bytes) -> None:
        first = re.search(rb"/First\s+(\d+)", head)
        if first:
            numbers = [int(x) for x in re.findall(rb"\d+", data[: int(first[1])])]
            places = [*zip(numbers[::2], numbers[1::2])]
            for (n, at), (_, end) in zip(places, [*places[1:], (0, len(data))]):
                self.objects.setdefault(n, (data[int(first[1]) + at : int(first[1]) + end], None))

    def stream(self, n: int) -> bytes:
        head, raw = self.objects.get(n, (b"", None))
        if raw is None:
            return b""
        return inflate(raw) if b"FlateDecode" in head else raw

    def refs(self, head: bytes, name: bytes) -> list[int]:
        m = re.search(rb"/" + name + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", head)
        return [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", m[1])] if m else []

    def pages(self) -> list[int]:
        """Page objects in reading order, by the page tree, else by number."""
        out, seen = [], set()

        def walk(n: int) -> None:
            if n in seen or n not in self.objects:
                return
            seen.add(n)
            head = self.objects[n][0]
            if re.search(rb"/Type\s*/Page\b(?!s)", head):
                out.append(n)
            for k in self.refs(head, rb"Kids"):
                walk(k)

        for n, (head, _) in sorted(self.objects.items()):
            if re.search(rb"/Type\s*/Catalog\b", head):
                for k in self.refs(head, rb"Pages"):
                    walk(k)
        rest = [n for n, (head, _) in sorted(self.objects.items()) if re.search(rb"/Type\s*/Page\b(?!s)", head) and n not in seen]
        return out + rest

    def fonts(self, page: int) -> dict[bytes, dict[bytes, str]]:
        """Code tables of a page's fonts by their names in its content."""
        head = self.objects[page][0]
        places = [head, *(self.objects[n][0] for n in self.refs(head, rb"Resources") if n in self.objects)]
        for n in self.refs(head, rb"Parent"):
            if n in self.objects:
                places += [self.objects[n][0], *(self.objects[k][0] for k in self.refs(self.objects[n][0], rb"Resources") if k in self.objects)]
        out: dict[bytes, dict[bytes, str]] = {}
        for place in places:
            for block in re.findall(rb"/Font\s*<<(.*?)>>", place, re.S) + [self.objects[n][0] for n in self.refs(place, rb"Font") if n in self.objects]:
                for name, n in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", block):
                    for k in self.refs(self.objects.get(int(n), (b"", None))[0], rb"ToUnicode"):
                        out.setdefault(name, code_table(self.stream(k)))
        return out


def code_table(cmap: bytes) -> dict[bytes, str]:
    """Codes and what they mean, from a ToUnicode table."""
    text = lambda h: literal(b"<" + h + b">").decode("utf-16-be", "replace")
    out: dict[bytes, str] = {}
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        for code, value in re.findall(rb"<([0-9A-Fa-f\s]+)>\s*<([0-9A-Fa-f\s]*)>", block):
            out[literal(b"<" + code + b">")] = text(value)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for lo, hi, one, many in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]*)>|\[([^\]]*)\])", block):
            a, b, width = int(lo, 16), int(hi, 16), (len(lo) + 1) // 2
            listed = re.findall(rb"<([0-9A-Fa-f]*)>", many)
            for k in range(min(b - a + 1, 65536)):
                if many:
                    value = text(listed[k]) if k < len(listed) else ""
                else:
                    base = text(one)
                    value = base[:-1] + chr(ord(base[-1]) + k) if base else ""
                out[(a + k).to_bytes(width, "big")] = value
    return out


def shown(data: bytes, table: dict[bytes, str] | None) -> str:
    if data.startswith(b"\xfe\xff"):
        return data[2:].decode("utf-16-be", "replace")
    if not table:
        return data.decode("cp1252", "replace")
    widths = sorted({len(k) for k in table}, reverse=True)
    out, i = [], 0
    while i < len(data):
        for w in widths:
            if (value := table.get(data[i : i + w])) is not None:
                out.append(value)
                i += w
                break
        else:
            i += widths[-1]
    return "".join(out)


def content_text(data: bytes, fonts: dict[bytes, dict[bytes, str]]) -> str:
    """Text that a content stream shows: a new line where the position moves vertically, a space for wide gaps."""
    out: list[str] = []
    args: list[bytes] = []
    table = None
    row = None

    def line() -> None:
        if out and out[-1] != "\n":
            out.append("\n")

    for token in _TOKEN.findall(data):
        if token[:1] in b"(</[]" and token not in (b"<<", b">>") or re.fullmatch(rb"[+-]?[\d.]+", token):
            args.append(token)
            continue
        if token == b"Tf" and len(args) >= 2:
            table = fonts.get(args[-2][1:])
        elif token in (b"Tj", b"'", b'"') and args:
            if token != b"Tj":
                line()
            out.append(shown(literal(args[-1]), table) if args[-1][:1] in b"(<" else "")
        elif token == b"TJ":
            for x in args:
                if x[:1] in b"(<":
                    out.append(shown(literal(x), table))
                elif re.fullmatch(rb"[+-]?[\d.]+", x) and float(x) <= -200:
                    out.append(" ")
        elif token in (b"Td", b"TD") and len(args) >= 2 and abs(_number(args[-1])) > 0.1 or token == b"T*":
            line()
        elif token == b"Tm" and len(args) >= 6:
            if row is not None and abs(_number(args[-1]) - row) > 0.1:
                line()
            row = _number(args[-1])
        elif token in (b"BT", b"ET"):
            line()
            row = None
        args = []
    return "".join(out)


def _number(x: bytes) -> float:
    try:
        return float(x)
    except ValueError:
        return 0.0


def extract(data: bytes) -> tuple[str, str | None]:
    """(text, reason): the text of a file, or an empty one and why there is none."""
    if b"%PDF" not in data[:1024]:
        return "", "not a PDF file inside"
    if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R|/Encrypt\s*<<", data):
        return "", "the PDF is locked with a password"
    pdf = Pdf(data)
    parts = []
    for page in pdf.pages():
        fonts = pdf.fonts(page)
        parts += [content_text(pdf.stream(n), fonts) for n in pdf.refs(pdf.objects[page][0], rb"Contents")]
    if not "".join(parts).strip():  # no usable page tree: every stream that shows text, with all code tables merged
        merged: dict[bytes, str] = {}
        for n, (_, raw) in pdf.objects.items():
            if raw is not None and b"beginbf" in (found := pdf.stream(n)):
                merged |= code_table(found)
        names = {x: merged for n, (head, raw) in pdf.objects.items() if raw is not None for x in re.findall(rb"/(\S+)\s+[\d.]+\s+Tf", pdf.stream(n))} if merged else {}
        parts = [content_text(found, names) for n, (_, raw) in sorted(pdf.objects.items()) if raw is not None and re.search(rb"\bT[jJ]\b", found := pdf.stream(n))]
    text = "\n\n".join(x.strip() for x in parts if x.strip())
    if text:
        return text, None
    whole = b"%%EOF" in data[-2048:] or re.search(rb"trailer|startxref", data[-8192:])
    return "", "a scan: pictures of pages without text" if whole else "the file is cut short"
