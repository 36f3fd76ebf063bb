"""Strings: Unicode forms, Markdown escapes, names, detectors. Plain functions; `arrow.column` puts them over columns."""

from __future__ import annotations

import base64
import binascii
import codecs
import re
import unicodedata

INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠎​-‏‪-‮⁠-⁤⁦-⁯﻿\U000e0000-\U000e007f]")


def nfc(text: str) -> str:
    """NFC, without characters that print nothing (line feeds and tabs stay)."""
    return "".join(c for c in unicodedata.normalize("NFC", text) if c in "\n\t" or unicodedata.category(c) not in ("Cc", "Cf", "Cs", "Co", "Cn"))


def slug(text: str) -> str:
    """NFKD, ASCII only, lower case, runs of anything else as one hyphen."""
    plain = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().lower()
    return re.sub(r"[^a-z0-9]+", "-", plain).strip("-")


def escape_inline(text: str) -> str:
    """A backslash before what would form Markdown: code ticks, emphasis that opens or closes at a word, link brackets, tags."""
    text = re.sub(r"([\\`])", r"\\\1", text)
    text = re.sub(r"\*(?=\S)|(?<=\S)\*", r"\\*", text)
    text = re.sub(r"(?<!\w)_(?=\S)|(?<=\S)_(?!\w)", r"\\_", text)
    text = re.sub(r"\[(?=[^\[\]]*\]\()", r"\\[", text)
    return re.sub(r"<(?=[A-Za-z/!])", r"\\<", text)


def _ticks(text: str) -> int:
    return max(map(len, re.findall("`+", text)), default=0)


def code_span(text: str) -> str:
    """text between ticks, one more than its longest run; a space inside where it starts or ends with one."""
    if not text:
        return ""
    marks = "`" * (_ticks(text) + 1)
    pad = " " if text[0] == "`" or text[-1] == "`" else ""
    return f"{marks}{pad}{text}{pad}{marks}"


def fence(text: str, language: str) -> str:
    marks = "`" * max(3, _ticks(text) + 1)
    return f"{marks}{language}\n{text.rstrip(chr(10))}\n{marks}"


def cut_heading(text: str, limit: int = 200) -> list[str | None]:
    """[heading, overflow]: a heading over the limit ends at its last whole word, with an ellipsis; the rest is kept."""
    if len(text) <= limit:
        return [text, None]
    at = text.rfind(" ", 0, limit)
    at = limit - 1 if at <= 0 else at
    return [text[:at].rstrip() + "…", text[at:].strip()]


def without_number(text: str) -> str:
    """A heading without its source's number (1., 1.2.3, IV., A)) and closing punctuation."""
    text = re.sub(r"^\s*(?:(?:\d+\.)+\d*|\d+\)|[IVXLC]+\.|[A-Z][.)]|\d+(?:\.\d+)+)\s+", "", text)
    return re.sub(r"[\s.:;,]+$", "", text)


def sentences(text: str) -> list[str]:
    return [x for x in re.split(r"(?<=[.!?])\s+", text.strip()) if x]


#: Digits and signs that Unicode has raised and lowered.
PLAIN = "0123456789+-=()"
RAISED = "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾"
LOWERED = "₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎"


def scripted(text: str, style: str) -> str:
    """Raised or lowered digits, where Unicode has all of them; otherwise ^(text) or _(text)."""
    table = RAISED if style == "super" else LOWERED
    if text and all(c in PLAIN for c in text):
        return text.translate(str.maketrans(PLAIN, table))
    return f"{'^' if style == 'super' else '_'}({text})"


def message_ids(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"<[^<>\s]+@[^<>\s]+>", text)))


def addresses(text: str) -> list[str]:
    """The addresses of a header, lower-cased, each once."""
    return list(dict.fromkeys(x.lower() for x in re.findall(r"[A-Za-z0-9._%+'-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", text)))


def mail_line(line: str) -> str:
    """What a line of a plain mail is: signature, reply_header, original, quote or text."""
    if line == "-- " or line == "--":
        return "signature"
    if re.match(r"^\s*(On\b.{4,200}\bwrote|Am\b.{4,200}\bschrieb\b.{0,80}|Le\b.{4,200}\ba écrit)\s*:\s*$", line):
        return "reply_header"
    if re.match(r"^\s*-{2,}\s*(Original Message|Forwarded message|Ursprüngliche Nachricht)\s*-{2,}\s*$", line, re.I):
        return "original"
    return "quote" if quote_depth(line) else "text"


def quote_depth(line: str) -> int:
    return re.match(r"(?:>\s?)*", line)[0].count(">")


def unflow(text: str) -> list[str]:
    """The lines of a flowed mail: a trailing space goes on at the same quote depth, stuffing goes, a signature's mark never flows."""
    out: list[str] = []
    held, depth = None, 0
    for line in text.replace("\r\n", "\n").split("\n"):
        quotes = re.match(r">*", line)[0]
        body = line[len(quotes) :].removeprefix(" ")
        flows = body.endswith(" ") and body != "-- "
        if held is not None and (len(quotes) != depth or body == "-- "):
            out.append(_quoted(held.rstrip(), depth))
            held = None
        held, depth = (held or "") + body, len(quotes)
        if not flows:
            out.append(_quoted(held, depth))
            held = None
    return out + ([_quoted(held.rstrip(), depth)] if held is not None else [])


def _quoted(text: str, depth: int) -> str:
    return ">" * depth + (" " if depth and text else "") + text


def squeeze(text: str, most: int = 32) -> str:
    """Runs of one non-ASCII character end at `most`."""
    return re.sub(rf"([^\x00-\x7f])\1{{{most},}}", lambda m: m[1] * most, text)


#: Letters of other scripts that look like Latin ones, and the Latin ones.
LOOK = "аеорсухіјѕԁԛԝһαορνικεΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
LATIN = "aeopcyxijsdqwhaopvikeABEZHIKMNOPTYX"


_LOOKALIKE = str.maketrans(LOOK, LATIN)
_APART = re.compile(r"(?<!\w)\w(?:[ .\-_*]\w(?!\w)){4,}")


def folded(text: str) -> str:
    """For scans: NFKC, nothing invisible, look-alikes as Latin, letters that stand apart joined, white space collapsed, case folded."""
    if not text.isascii():
        text = INVISIBLE.sub("", unicodedata.normalize("NFKC", text)).translate(_LOOKALIKE)
    text = _APART.sub(lambda m: re.sub(r"[ .\-_*]", "", m[0]), text)
    return " ".join(text.split()).casefold()


def defang(text: str, tag: str = "untrusted") -> str:
    """A zero-width space into every closing tag of that name, however it is spelled, so that no text can end its fence."""
    loose = r"[\s​-‏⁠﻿]*".join(map(re.escape, tag))
    return re.sub(rf"<(\s*/\s*{loose})", "<​\\1", text, flags=re.I)


def without_ansi(text: str) -> str:
    return re.sub(r"\x1b(?:\[[0-?]*[ -/]*[@-~]|\][^\x07\x1b]*(?:\x07|\x1b\\)|[@-Z\\-_])", "", text)


def redact_log(text: str) -> str:
    """Keys and tokens as [redacted]."""
    text = re.sub(r"(?i)\b(bearer|basic)\s+[A-Za-z0-9._~+/=-]{8,}", r"\1 [redacted]", text)
    text = re.sub(r"(?i)\b((?:api[_-]?key|token|secret|password|passwd)\s*[=:]\s*)[^\s&,;\"']+", r"\1[redacted]", text)
    return re.sub(r"://[^/\s:@]+:[^/\s@]+@", "://[redacted]@", text)


def dehyphenate(line: str, following: str, vocabulary: list[str]) -> str:
    """Two lines as one: a hyphen at the break goes where the joined word is in the vocabulary, else it stays, with no space."""
    left, right = re.search(r"(\w+)-$", line), re.match(r"\w+", following)
    if not left or not right:
        return f"{line} {following}".strip()
    known = (left[1] + right[0]).lower() in {w.lower() for w in vocabulary}
    return (line[:-1] if known else line) + following


def safe_stem(name: str, limit: int = 80) -> str:
    """A file's stem that every file system takes."""
    stem = re.sub(r"\.[A-Za-z0-9]{1,8}$", "", name.replace("\\", "/").rpartition("/")[2])
    stem = re.sub(r'[\x00-\x1f<>:"|?*]+|\s+', "-", unicodedata.normalize("NFC", stem)).strip(" .-")[:limit].rstrip(" .-")
    return f"{stem or 'document'}_" if re.fullmatch(r"(?i)con|prn|aux|nul|com\d|lpt\d", stem) else stem or "document"


def likeness(a: str, b: str) -> float:
    """2 * (longest common subsequence) / (both lengths); 1 for two empty texts."""
    if not a and not b:
        return 1.0
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return round(2 * row[-1] / (len(a) + len(b)), 6)


def cell_key(text: str) -> str:
    """A table cell for comparison: white space collapsed, case folded, numbers without separators and trailing zeros."""
    text = re.sub(r"\s+", " ", text).strip().casefold()
    plain = re.sub(r"[,\s'$€£%]", "", text)
    if re.fullmatch(r"[+-]?\d*\.?\d+", plain):
        return plain.rstrip("0").rstrip(".") if "." in plain else plain
    return text


def troubles(text: str) -> list[str]:
    """Signs of a bad conversion: mojibake, replacement characters, control characters, a long run of one character."""
    found = []
    if len(re.findall("Ã[\u0080-¿]|â€[\u0080-ÿ™œ]|Â[ -¿]", text)) >= 3:
        found.append("mojibake")
    if text.count("�") >= max(3, len(text) // 1000):
        found.append("replacement")
    if re.search(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", text):
        found.append("control")
    if re.search(r"([^\s\-=_.*#])\1{199,}", text):
        found.append("run")
    return found


def decoded(text: str) -> list[str]:
    """Readable texts that a text holds as base64 or hexadecimal blobs, and its rot13 where that names instructions."""
    out = []
    for blob in re.findall(r"[A-Za-z0-9+/]{24,}={0,2}", text):
        try:
            out.append(base64.b64decode(blob + "=" * (-len(blob) % 4), validate=True).decode())
        except (binascii.Error, UnicodeDecodeError):
            pass
    for blob in re.findall(r"\b(?:[0-9a-fA-F]{2}){12,}\b", text):
        try:
            out.append(bytes.fromhex(blob).decode())
        except UnicodeDecodeError:
            pass
    turned = codecs.decode(text, "rot13") if "vafgehpgvba" in text.lower() else ""  # rot13 of instruction
    if turned and re.search(r"(?i)\b(ignore|disregard|forget)\b.{0,40}\binstructions?\b", turned):
        out.append(turned)
    return [x for x in dict.fromkeys(out) if x.isprintable() or "\n" in x]


#: Languages of code by file extension and by the program of a shebang.
LANGUAGES = {"py": "python", "js": "javascript", "ts": "typescript", "rs": "rust", "go": "go", "java": "java", "rb": "ruby", "sh": "bash", "c": "c", "h": "c", "cpp": "cpp", "cs": "csharp", "sql": "sql", "html": "html", "css": "css", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "md": "markdown", "r": "r", "kt": "kotlin", "scala": "scala", "swift": "swift", "php": "php", "xml": "xml"}
PROGRAMS = {"python": "python", "bash": "bash", "sh": "bash", "zsh": "bash", "node": "javascript", "ruby": "ruby", "perl": "perl"}


def code_language(name: str, text: str) -> str | None:
    """By class (language-x), extension, or shebang."""
    if m := re.search(r"\b(?:language|lang|highlight)-([A-Za-z0-9+#]+)", name):
        return LANGUAGES.get(m[1].lower(), m[1].lower())
    if (m := re.search(r"\.([A-Za-z]+)$", name)) and m[1].lower() in LANGUAGES:
        return LANGUAGES[m[1].lower()]
    if m := re.match(r"#!\s*\S*?(?:/env\s+)?([A-Za-z]+)[\d.]*\s", text + "\n"):
        return PROGRAMS.get(m[1])
    return None


def roman(n: int) -> str:
    out = ""
    for value, letters in ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")):
        out, n = out + letters * (n // value), n % value
    return out


def math_spans(text: str) -> list[str]:
    """The formulas between single dollars: no space inside the marks, no digit after the closing one."""
    return re.findall(r"(?<![\\$\w])\$(?=\S)([^$\n]*?[^\s\\$])\$(?![\d$])", text)


def signatures(text: str) -> list[str]:
    """Lines of source that declare something: classes, functions, types."""
    keep = r"\s*(?:(?:export|public|private|protected|static|async|abstract|final|pub|default)\s+)*(?:class|def|function|func|fn|interface|struct|enum|trait|impl|type)\b[^\n]*"
    return [re.sub(r"\s*[{:]\s*$", "", x.rstrip()) for x in text.split("\n") if re.fullmatch(keep, x)]
