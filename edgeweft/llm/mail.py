"""The subject and the newly written text of an archived e-mail."""

from __future__ import annotations

import base64
import binascii
import html
import quopri
import re

_HEADER = re.compile(rb"^[A-Za-z][A-Za-z0-9-]*:[ \t]?")
_NAME = re.compile(r"^([A-Za-z][A-Za-z0-9-]*):[ \t]*(.*)$", re.S)
_BOUNDARY = re.compile(r"boundary=\"?([^\";\s]+)", re.I)
_WORD = re.compile(r"=\?([^?\s]+)\?([BbQq])\?([^?]*)\?=(?:\s+(?==\?))?")
_DROPPED = re.compile(r"<(style|script|head|title|noscript)\b[^>]*>.*?</\1\s*>|<!--.*?-->", re.I | re.S)
_BREAK = re.compile(r"<(?:br|/p|/div|/li|/tr|/h[1-6]|/blockquote|p|div|tr|li|h[1-6])\b[^>]*>", re.I)
_TAG = re.compile(r"</?(?:a|abbr|b|big|blockquote|body|center|code|div|em|font|h[1-6]|head|hr|html|i|img|li|link|meta|ol|p|pre|small|span|strong|style|sub|sup|table|tbody|td|th|thead|title|tr|tt|u|ul|noscript|!doctype|o:p)\b[^<>]*/?>", re.I)
_BLOCKQUOTE = re.compile(r"<(/?)blockquote\b[^>]*>", re.I)
_BASE64_LINE = re.compile(r"^[A-Za-z0-9+/]{16,}={0,2}$")
_LINE_END = re.compile(r"\r\n|\n|\r")
_SPACES = re.compile(r"[ \t ]+")


def _header_end(text: str) -> int:
    for gap in re.finditer(r"\r?\n[ \t]*\r?\n|\r\r", text):
        return gap.start()
    return len(text)


def headers_of(block: str) -> dict[str, str] | None:
    """Headers by lower-case name, the first of each; None if the block doesn't look like headers."""
    out: dict[str, str] = {}
    name = ""
    for line in re.split(r"\r\n|\n|\r", block):
        if line[:1] in " \t" and name:
            out[name] += " " + line.strip()
            continue
        m = _NAME.match(line)
        if not m:
            if not out:
                return None
            continue
        name = m[1].lower()
        if name in out:
            name = f"{name} again"
        out[name] = m[2]
    return out


def decode_words(value: str) -> str:
    def one(m: re.Match) -> str:
        try:
            raw = base64.b64decode(m[3] + "===") if m[2] in "Bb" else quopri.decodestring(m[3].replace("_", " ").encode("latin-1", "replace"))
            return raw.decode(m[1], "replace")
        except (LookupError, ValueError, binascii.Error):
            return m[0]

    return _WORD.sub(one, value)


def _decoded(body: str, encoding: str, charset: str) -> str:
    encoding = encoding.strip().lower()
    try:
        if encoding == "base64":
            letters = re.sub(r"[^A-Za-z0-9+/]", "", body.split("\n--", 1)[0])
            raw = base64.b64decode(letters[: len(letters) // 4 * 4] + (letters[len(letters) // 4 * 4 :] + "===")[:4] * (len(letters) % 4 > 1))
        elif encoding == "quoted-printable":
            raw = quopri.decodestring(body.encode("utf-8", "surrogatepass"))
        else:
            return body
    except (ValueError, binascii.Error):
        return body
    for name in ("utf-8", charset or "latin-1", "latin-1"):
        try:
            return raw.decode(name)
        except (LookupError, UnicodeDecodeError):
            continue
    return raw.decode("utf-8", "replace")


def _without_blockquotes(page: str) -> str:
    """The page with an empty quoted line for each outermost blockquote, up to its own end tag; one that isn't closed goes to the end of the page."""
    out, at, depth = [], 0, 0
    for m in _BLOCKQUOTE.finditer(page):
        if not m[1]:
            if not depth:
                out += page[at : m.start()], "<br>> <br>"
            depth += 1
        elif depth:
            depth -= 1
            at = m.end()
    return "".join(out) + ("" if depth else page[at:])


def html_text(page: str) -> str:
    page = _DROPPED.sub(" ", page)
    page = _without_blockquotes(page)
    page = page.replace("\r\n", "\n")
    page = re.sub(r"\s*\n\s*", " ", page)
    page = _BREAK.sub("\n", page)
    return html.unescape(_TAG.sub("", page))


def _looks_html(body: str) -> bool:
    return bool(re.match(r"\s*<(?:html|!doctype|body|div|table|p)\b", body, re.I))


def text_parts(text: str, depth: int = 0) -> tuple[str | None, list[str]]:
    """The subject and the decoded plain texts of the message's own parts, without attachments.

    Of alternatives the plain one is taken, the HTML one where that is empty. A message that
    lost its headers is taken as it stands, decoded if it is plainly base64 or quoted-printable.
    """
    end = _header_end(text)
    head = headers_of(text[:end]) if _HEADER.match(text[:200].encode("utf-8", "surrogatepass")) else None
    if head is None:
        return None, _headless(text)
    body = text[end:].lstrip("\r\n")
    subject = decode_words(head["subject"]) if "subject" in head else None
    return subject, _parts(head, body, depth)


def _headless(text: str) -> list[str]:
    lines = text.split()
    if lines and all(_BASE64_LINE.match(x) for x in lines[:-1]) and len(lines[0]) >= 16 and " " not in text.strip():
        text = _decoded(text, "base64", "utf-8")
    elif re.search(r"=[0-9A-F]{2}=[0-9A-F]{2}|=3D|=\r?\n", text):
        text = _decoded(text, "quoted-printable", "utf-8")
    m = re.match(r"(?:[^\n]*\n){0,3}?--(\S+)\r?\n(?=content-)", text, re.I)
    if m:
        return _parts({"content-type": f'multipart/mixed; boundary="{m[1]}"'}, text, 0)
    return [html_text(text) if _looks_html(text) else text]


def _between(body: str, mark: str) -> list[str]:
    """The body cut at the lines that hold nothing but the mark, and maybe two dashes and blanks after it."""
    pieces, start, at = [], 0, body.find(mark)
    while at >= 0:
        end = at + len(mark)
        if body.startswith("--", end):
            end += 2
        while body[end : end + 1] in (" ", "\t"):
            end += 1
        if (not at or body[at - 1] == "\n") and (end == len(body) or body.startswith(("\n", "\r\n"), end)):
            before = max(start, at - 1 if at else 0)
            if before > start and body[before - 1] == "\r":
                before -= 1
            pieces.append(body[start:before])
            start = end
        at = body.find(mark, max(end, at + 1))
    return [*pieces, body[start:]]


def _parts(head: dict[str, str], body: str, depth: int) -> list[str]:
    kind = head.get("content-type", "text/plain")
    low = kind.lower()
    if "attachment" in head.get("content-disposition", "").lower():
        return []
    if low.startswith("multipart/") and depth < 8:
        m = _BOUNDARY.search(kind)
        pieces = _between(body, "--" + m[1]) if m else [body]
        found = []
        for piece in pieces[1:] if m else pieces:
            piece = re.sub(r"^\r?\n", "", piece, count=1)
            if not piece.strip():
                continue
            end = _header_end(piece)
            own = headers_of(piece[:end]) or {}
            if not any(k.startswith("content-") for k in own):
                own, end = {}, 0
            part = _parts(own, piece[end:].lstrip("\r\n") if own else piece, depth + 1)
            found.append((own.get("content-type", "text/plain").lower(), part))
        if "alternative" in low:
            plain = [p for k, p in found if k.startswith("text/plain") and any(x.strip() for x in p)]
            if plain:
                return plain[0]
            return next((p for k, p in found if any(x.strip() for x in p)), [])
        return [x for _, p in found for x in p]
    if not low.startswith(("text/", "multipart/")) and "/" in low:
        return []
    charset = re.search(r"charset=\"?([\w-]+)", kind, re.I)
    text = _decoded(body, head.get("content-transfer-encoding", ""), charset[1] if charset else "")
    return [html_text(text) if "html" in low or _looks_html(text) else text]


# How quoted and forwarded messages, signatures and disclaimers begin.
_QUOTE = re.compile(r"^\s*[>|]")
_ORIGINAL = re.compile(r"^\s*-{2,}\s*(?:original message|forwarded message|ursprüngliche nachricht|weitergeleitete nachricht|message d'origine|message transféré|mensaje original|mensaje reenviado)\b|^\s*begin forwarded message", re.I)
_ATTRIBUTION = re.compile(r"^\s*(?:on\b.{4,120}\bwrote|am\b.{4,120}\bschrieb\b.{0,60}|le\b.{4,120}\ba écrit|el\b.{4,120}\bescribió|[^<>\n]{1,60}<[^<>@\s]+@[^<>\s]+>)\s*:\s*$", re.I)
_NAMED = re.compile(r"^[^<>\n]{1,60}<[^<>@\s]+@[^<>\s]+>\s*:\s*$")
_WROTE = r"\s(?:On\b[^>|\n]{4,120}\bwrote|Am\b[^>|\n]{4,120}\bschrieb\b[^>|\n]{0,60}|Le\b[^>|\n]{4,120}\ba écrit|El\b[^>|\n]{4,120}\bescribió|[^<>|\n]{1,60}<[^<>@\s]+@[^<>\s]+>)\s*: ?[>|] "
# a quote whose lines were joined ends at a blank line (two spaces) between texts without a mark
_JOINED_END = rf"(?=$|(?<![\s>|])  (?![\s>|])(?! ?{_WROTE[2:]}))"
_JOINED = re.compile(rf"{_WROTE}.*?{_JOINED_END}")
_JOINED_MORE = re.compile(rf"  [>|]+ .*?{_JOINED_END}")
_INLINE = re.compile(r"\s(?:_{20,}|\*{3}|--)\s.*|\s-----Original Message-----.*")
_WROTE_WORD = re.compile(r"wrote|schrieb|a écrit|escribió", re.I)
_RULE = re.compile(r"^\s*(?:--|\*{3,}|_{20,}|-{5,}|={5,})\s*$")


def _own_of_line(line: str, below: bool) -> str:
    line = " " + line
    first = _JOINED.search(line) if ":" in line and (">" in line or "|" in line) else None
    if first:
        rest = _JOINED_MORE.sub("", _JOINED.sub("", line[first.end() :])) if below else ""
        line = _INLINE.sub("", line[: first.start()]) + _INLINE.sub("", rest)
    elif "--" in line or "***" in line or "____" in line:
        line = _INLINE.sub("", line)
    return _SPACES.sub(" ", line).strip()


def quotes_in_line(parts: list[str]) -> bool:
    """Whether any part may hold an attribution like "On ... wrote:"; without one all its own text stands above the first quote."""
    return any(":" in x and (">" in x or _WROTE_WORD.search(x)) for x in parts)


def own_lines(parts: list[str], below: bool = True) -> list[str]:
    """Lines of the newly written text, above, between and below quotes: without quoted and forwarded messages, and without what follows a rule (signature, disclaimer).

    A quote is its marked lines; an empty line stands for each. A forwarded or original message, and an attribution like "On ... wrote:"
    without marked lines after it, has no mark where it ends and goes to the end of the part. After an attribution a rule above it no longer holds.
    below=False: only what stands above the first attribution of each part.
    """
    out: list[str] = []
    for text in parts:
        ruled = False
        lines = _LINE_END.split(text)
        for i, line in enumerate(lines):
            bare = line.strip()
            if not bare:
                if not ruled:
                    out.append("")
                continue
            if bare[0] in ">|":
                out.append("")
                continue
            if bare[0] in "-bB" and _ORIGINAL.match(line):
                break
            if bare[-1] == ":" and _ATTRIBUTION.match(line):
                if below and _QUOTE.match(next((x for x in lines[i + 1 :] if x.strip()), "")):
                    ruled = False
                    continue
                if not below or not _NAMED.match(line):
                    break
            if bare[0] in "-*_=" and _RULE.match(line):
                ruled = True
                continue
            if not ruled:
                out.append(_own_of_line(line, below))
    return out


def passages(lines: list[str]) -> list[str]:
    """Paragraphs with their wrapped lines joined."""
    out, held = [], []
    for line in [*lines, ""]:
        if line:
            held.append(line)
        elif held:
            out.append(" ".join(held))
            held = []
    return out
