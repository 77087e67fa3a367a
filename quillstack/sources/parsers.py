"""One parser for each format; all give pages of (page_number, text) or, from OCR, (page_number, text, confidence).

A parser is a small function from a file's bytes to its pages. New formats are
added to the registry; consumers never look at the format. Formats whose
libraries are not installed (PDF, scans, .msg) raise Unsupported until a
parser is registered for them.
"""

from __future__ import annotations

import csv
import email
import email.policy
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from datetime import datetime, time, timedelta
from html.parser import HTMLParser
from xml.etree import ElementTree

Pages = list[tuple[int, str] | tuple[int, str, float]]
Parser = Callable[[bytes], Pages]


class Unsupported(Exception):
    """No parser for this format is installed."""


#: Source type and MIME type by extension.
FORMATS = {
    "txt": ("txt", "text/plain"),
    "csv": ("xlsx", "text/csv"),
    "docx": ("docx", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"),
    "xlsx": ("xlsx", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"),
    "pptx": ("pptx", "application/vnd.openxmlformats-officedocument.presentationml.presentation"),
    "eml": ("email", "message/rfc822"),
    "msg": ("email", "application/vnd.ms-outlook"),
    "pdf": ("pdf", "application/pdf"),
    "png": ("image", "image/png"),
    "jpg": ("image", "image/jpeg"),
    "tiff": ("image", "image/tiff"),
    "html": ("txt", "text/html"),
}


def text_pages(content: bytes) -> Pages:
    return [(1, content.decode("utf-8", "replace"))]


def csv_pages(content: bytes) -> Pages:
    """The whole sheet is page 1, a line a row, tabs between cells."""
    rows = csv.reader(io.StringIO(content.decode("utf-8-sig", "replace")))
    return [(1, "\n".join("\t".join(r) for r in rows))]


def _xml(archive: zipfile.ZipFile, name: str) -> ElementTree.Element:
    return ElementTree.fromstring(archive.read(name))


def _local(node: ElementTree.Element) -> str:
    return node.tag.rpartition("}")[2]


def _paragraphs(root: ElementTree.Element) -> str:
    lines = []
    for p in root.iter():
        if _local(p) == "p":
            lines.append("".join(t.text or "" if _local(t) == "t" else "\n" if _local(t) == "br" else "\t" for t in p.iter() if _local(t) in ("t", "tab", "br")))
    return "\n".join(lines)


def docx_pages(content: bytes) -> Pages:
    """Hard page breaks are not tracked: the body is page 1."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return [(1, _paragraphs(_xml(z, "word/document.xml")))]


def members(filename: str, content: bytes, most: int) -> Iterator[tuple[str | None, str | None, int | None, bytes | None]]:
    """(path within the container, filename, size, content) of each file in a container; (None, ...) for a file that stands for itself."""
    kind = filename.rpartition(".")[2].lower()
    if kind == "zip":
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for entry in z.infolist():
                if not entry.is_dir():
                    yield entry.filename, entry.filename.rpartition("/")[2], entry.file_size, z.read(entry) if entry.file_size <= most else None
    elif kind == "mbox":
        starts = [m.start() for m in re.finditer(rb"(?m)^From [^\n]*\n", content)]
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(content)], strict=True)):
            body = re.sub(rb"(?m)^>(>*From )", rb"\1", content[a:b].partition(b"\n")[2].rstrip(b"\n") + b"\n")
            yield f"{k}", f"message-{k}.eml", len(body), body if len(body) <= most else None
    else:
        yield None, None, None, None
        if kind == "eml":
            message = email.message_from_bytes(content, policy=email.policy.default)
            for k, part in enumerate(message.iter_attachments()):
                body = part.get_payload(decode=True) or b""
                name = part.get_filename() or f"attachment-{k}"
                yield f"{k}/{name}", name, len(body), body if len(body) <= most else None


def _numbered(z: zipfile.ZipFile, pattern: str) -> list[str]:
    found = [(int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(found)]


def pptx_pages(content: bytes) -> Pages:
    """One page a slide."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return [(k, _paragraphs(_xml(z, n))) for k, n in enumerate(_numbered(z, r"ppt/slides/slide(\d+)\.xml"), 1)]


#: Numbers of the built-in formats of dates and times.
DATE_FORMATS = frozenset([14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47])


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show a number as a date: a built-in format, or one of its own with a year, day or hour."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = _xml(z, "xl/styles.xml")
    own = {int(n.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", n.get("formatCode", "")).lower() for n in root.iter() if _local(n) == "numFmt"}
    dated = DATE_FORMATS | {k for k, code in own.items() if re.search("[ydh]", code)}
    styles = next((x for x in root if _local(x) == "cellXfs"), [])
    return {k for k, x in enumerate(styles) if int(x.get("numFmtId", "0")) in dated}


def _day(value: str) -> str:
    """A spreadsheet's day number as an ISO date, with the time if there is one."""
    at = datetime(1899, 12, 30) + timedelta(seconds=round(float(value) * 86_400))
    return at.date().isoformat() if at.time() == time() else at.isoformat()


def xlsx_pages(content: bytes) -> Pages:
    """One page a sheet, a line a row, tabs between cells; dates as ISO dates."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter() if _local(t) == "t") for si in _xml(z, "xl/sharedStrings.xml") if _local(si) == "si"]
        dates = _date_styles(z)
        pages = []
        for k, name in enumerate(_numbered(z, r"xl/worksheets/sheet(\d+)\.xml"), 1):
            lines = []
            for row in (x for x in _xml(z, name).iter() if _local(x) == "row"):
                cells = []
                for c in row:
                    value = "".join(v.text or "" for v in c.iter() if _local(v) in ("v", "t"))
                    if value and c.get("t", "n") == "n" and int(c.get("s", "0")) in dates:
                        value = _day(value)
                    cells.append(shared[int(value)] if c.get("t") == "s" and value else value)
                lines.append("\t".join(cells))
            pages.append((k, "\n".join(lines)))
        return pages


#: Headers of a message that decide on its text, and the values with which that is what follows the headers, as it is.
_NAMED = re.compile(rb"[!-9;-~]+:[ -~\t]*")
_PLAIN = {
    b"content-type": re.compile(rb'text/(?:plain|html)(?:; ?charset=(?:utf-8|us-ascii|"utf-8"|"us-ascii"))?', re.I),
    b"content-transfer-encoding": re.compile(rb"7bit|8bit", re.I), b"content-disposition": re.compile(rb"inline", re.I), b"subject": re.compile(rb"(?:(?!=\?)[ -~])*"),
}


def _plain_message(content: bytes) -> tuple[str, str] | None:
    """Subject and text of a message of one part without encoded or folded headers; None for any other. The email package takes a hundred times as long for it."""
    head, blank, body = content.partition(b"\n\n")
    lines = head.split(b"\n")
    if not blank or b"\r" in content or not all(map(_NAMED.fullmatch, lines)):
        return None
    found: dict[bytes, bytes] = {}
    for line in lines:
        name, _, value = line.partition(b":")
        name, value = name.lower(), value.lstrip(b" \t")
        if name in _PLAIN:
            if name in found or not _PLAIN[name].fullmatch(value):
                return None
            found[name] = value
    charset = "utf-8" if b"utf-8" in found.get(b"content-type", b"").lower() else "ascii"
    return found.get(b"subject", b"").decode(), body.decode(charset, "replace")


def eml_pages(content: bytes) -> Pages:
    """Subject, then the plain-text body."""
    plain = _plain_message(content)
    if plain is not None:
        return [(1, f"{plain[0]}\n{plain[1]}".strip())]
    message = email.message_from_bytes(content, policy=email.policy.default)
    body = message.get_body(preferencelist=("plain", "html"))
    text = body.get_content() if body is not None else ""
    return [(1, f"{message['subject'] or ''}\n{text}".strip())]


class _Text(HTMLParser):
    def __init__(self):
        super().__init__()
        self.parts, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden and data.strip():
            self.parts.append(data.strip())


def html_pages(content: bytes) -> Pages:
    parser = _Text()
    parser.feed(content.decode("utf-8", "replace"))
    return [(1, "\n".join(parser.parts))]


def unsupported(content: bytes) -> Pages:
    raise Unsupported("no parser is installed for this format")


PARSERS: dict[str, Parser] = {
    "txt": text_pages, "csv": csv_pages, "docx": docx_pages, "xlsx": xlsx_pages, "pptx": pptx_pages, "eml": eml_pages, "html": html_pages,
    "msg": unsupported, "pdf": unsupported, "png": unsupported, "jpg": unsupported, "tiff": unsupported,
}
