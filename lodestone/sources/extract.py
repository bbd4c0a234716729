"""Text, status, reason and author of one file's bytes, by its extension. Nothing here raises."""

from __future__ import annotations

import html
import io
import re
import unicodedata
import zipfile
from xml.etree import ElementTree

from lodestone.sources import pdf

# Kinds of files by extension (fixed values).
TEXT = {*".txt .md .markdown .csv .tsv .json .log .rtf .ini .cfg .yml .yaml .srt .vtt".split()}
MARKUP = {*".html .htm .xml .xhtml .svg".split()}
OFFICE = {*".docx .docm .xlsx .xlsm .pptx .pptm".split()}
LEGACY = {
    ".doc": "open it in a word processor and save it as .docx", ".xls": "open it in a spreadsheet and save it as .xlsx", ".ppt": "open it in a presentation program and save it as .pptx", ".wpd": "save it as .docx or PDF",
    ".pub": "export it as PDF", ".msg": "save the message as text or PDF", ".one": "export the pages as PDF or .docx",
}
READ = TEXT | MARKUP | OFFICE | {".pdf"}
LARGEST, LARGEST_PART, LONGEST = 40 << 20, 80 << 20, 1_500_000


def decode(data: bytes) -> str:
    """UTF-8, with or without its mark, else Windows-1252, else Latin-1."""
    for name in ("utf-8-sig", "cp1252"):
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return data.decode("latin-1")


# Spaces that are one to a reader, parts of pages that aren't shown, and tags that end a line (fixed values).
SPACES = " \t\u00a0\u2007\u202f"
UNSEEN, LINE_ENDS = ("script", "style", "head"), "p div br li tr h1 h2 h3 h4 h5 h6 section article"


def tidy(text: str) -> str:
    """Text in canonical composition, with even spaces and at most one blank line in a row."""
    whole = unicodedata.normalize("NFC", text.replace("\r\n", "\n").replace("\r", "\n").replace("\0", " "))
    even, out = str.maketrans(dict.fromkeys(SPACES, " ")), []
    for line in whole.split("\n"):
        line = re.sub(" {2,}", " ", line.translate(even)).strip(" ")
        if line or out and out[-1]:
            out.append(line)
    return "\n".join(out).strip()


def strip_markup(text: str) -> str:
    for name in UNSEEN:
        text = re.sub(rf"(?is)<{name}\b.*?</{name}>", " ", text)
    ends = "|".join(LINE_ENDS.split())
    text = re.sub(rf"(?i)</(?:{ends})\s*>|<br\s*/?>", "\n", re.sub(r"(?s)<!--.*?-->", " ", text))
    return html.unescape(re.sub(r"(?s)<[^>]{0,4000}>", " ", text))


def real_words(text: str) -> bool:
    """12 characters or more, and at least 45 in a hundred of them letters or digits."""
    shown = sum(not c.isspace() for c in text)
    return shown >= 12 and 100 * sum(map(str.isalnum, text)) >= 45 * shown


def _parts(archive: zipfile.ZipFile, pattern: str) -> list[str]:
    key = lambda n: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", n)]
    return sorted((n for n in archive.namelist() if re.fullmatch(pattern, n)), key=key)


def _tree(archive: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    try:
        if archive.getinfo(name).file_size > LARGEST_PART:
            return None
        return ElementTree.fromstring(archive.read(name))
    except (KeyError, ElementTree.ParseError, zipfile.BadZipFile, OSError, RuntimeError):
        return None


def _name(node: ElementTree.Element) -> str:
    return node.tag.rsplit("}", 1)[-1] if isinstance(node.tag, str) else ""


def _paragraphs(tree: ElementTree.Element) -> list[str]:
    out = []
    for p in tree.iter():
        if _name(p) == "p":
            bits = {"t": lambda x: x.text or "", "tab": lambda x: "\t", "br": lambda x: "\n", "cr": lambda x: "\n"}
            out.append("".join(bits[_name(x)](x) for x in p.iter() if _name(x) in bits))
    return out


def word(archive: zipfile.ZipFile) -> str:
    names = ["word/document.xml", *_parts(archive, r"word/(?:header|footer)\d*\.xml"), *_parts(archive, r"word/(?:footnotes|endnotes)\.xml")]
    return "\n".join(x for n in names if (tree := _tree(archive, n)) is not None for x in _paragraphs(tree))


def sheets(archive: zipfile.ZipFile) -> str:
    words = lambda node: "".join(x.text or "" for x in node.iter() if _name(x) == "t")
    shared_tree = _tree(archive, "xl/sharedStrings.xml")
    shared = [words(x) for x in shared_tree if _name(x) == "si"] if shared_tree is not None else []
    lines = []
    for name in _parts(archive, r"xl/worksheets/sheet\d+\.xml"):
        tree = _tree(archive, name)
        for row in (x for x in tree.iter() if _name(x) == "row") if tree is not None else ():
            cells = []
            for c in (x for x in row if _name(x) == "c"):
                value = next((x.text or "" for x in c if _name(x) == "v"), None)
                if c.get("t") == "s" and value is not None and value.isdigit() and int(value) < len(shared):
                    value = shared[int(value)]
                cells.append(value if value is not None else words(c))
            if any(cells):
                lines.append("\t".join(cells))
    return "\n".join(lines)


def slides(archive: zipfile.ZipFile) -> str:
    blocks = []
    for name in _parts(archive, r"ppt/slides/slide\d+\.xml") + _parts(archive, r"ppt/notesSlides/notesSlide\d+\.xml"):
        if (tree := _tree(archive, name)) is not None:
            blocks.append("\n".join(x for x in _paragraphs(tree) if x.strip()))
    return "\n\n".join(x for x in blocks if x)


def author(archive: zipfile.ZipFile) -> str | None:
    tree = _tree(archive, "docProps/core.xml")
    found = {_name(x): (x.text or "").strip() for x in tree.iter()} if tree is not None else {}
    return (found.get("creator") or found.get("lastModifiedBy") or "")[:120] or None


def extract(data: bytes, ext: str, longest: int | None = LONGEST) -> tuple[str, str, str | None, str | None]:
    """(status, text, reason, author): status is ok, unreadable or skipped. longest: characters of a text that are kept (None: all);
    the reason of a readable file says so if its text is longer."""
    ext, who, reason = ext.lower(), None, None
    if ext in LEGACY:
        return "unreadable", "", f"{ext} is an old or closed format: {LEGACY[ext]}", None
    if ext not in READ:
        return "skipped", "", f"{ext or 'files without extension'} files are not read", None
    if not data:
        return "unreadable", "", "the file is empty", None
    try:
        if ext in TEXT:
            text = decode(data)
        elif ext in MARKUP:
            text = strip_markup(decode(data))
        elif ext == ".pdf":
            text, reason = pdf.extract(data)
        else:
            with zipfile.ZipFile(io.BytesIO(data)) as archive:
                who = author(archive)
                text = {"d": word, "x": sheets, "p": slides}[ext[1]](archive)
        text = tidy(text)
    except zipfile.BadZipFile:
        return "unreadable", "", "the Office file is damaged", None
    except Exception as error:  # a reader's fault must not lose the file's record
        return "unreadable", "", f"could not be read ({type(error).__name__})", None
    if reason:
        return "unreadable", "", reason, who
    if not text.split() or ext == ".pdf" and not real_words(text):
        return "unreadable", "", "no words in it", who
    if longest is not None and len(text) > longest:
        return "ok", text[:longest], f"only the first {longest} of {len(text)} characters are kept", who
    return "ok", text, None, who
