"""Texts, Markdown, HTML and mail as ordered blocks: (kind, level, text)."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from tessera.functions import strings

FIELDS = "ord int, kind string, level int, text string"
Block = tuple[str, int, str]


def numbered(blocks: list[Block]) -> list[tuple]:
    return [(i, *b) for i, b in enumerate(blocks)]


def aligned_table(lines: list[str]) -> list[list[str]] | None:
    """The cells of three or more lines of equally many columns, two spaces or a tab apart, whose starts agree within one."""
    if len(lines) < 3:
        return None
    rows = [[(m.start(), m[0].strip()) for m in re.finditer(r"\S+(?: \S+)*", x.expandtabs(8))] for x in lines]
    if len({len(r) for r in rows}) != 1 or len(rows[0]) < 2:
        return None
    near = all(abs(a[0] - b[0]) <= 1 for r in rows[1:] for a, b in zip(rows[0], r, strict=True))
    return [[x for _, x in r] for r in rows] if near else None


def plain_blocks(text: str) -> list[Block]:
    """Plain text: underlined and all-capital headings, lists, indented code, aligned tables, paragraphs."""
    out: list[Block] = []
    for part in re.split(r"\n[ \t]*\n", text.replace("\r\n", "\n")):
        lines = [x.rstrip() for x in part.strip("\n").split("\n")]
        if not any(lines):
            continue
        if len(lines) >= 2 and re.fullmatch(r"(=+|-+|~+)", lines[1]) and len(lines[1]) >= 3:
            out.append(("heading", 1 if lines[1][0] == "=" else 2, lines[0].strip()))
            lines = lines[2:]
            if not lines:
                continue
        if len(lines) == 1 and re.search("[A-Z]{3}", lines[0]) and lines[0] == lines[0].upper() and len(lines[0]) <= 80 and not lines[0].endswith((".", ",")):
            out.append(("heading", 2, lines[0].strip()))
        elif all(x.startswith(("    ", "\t")) for x in lines if x):
            out.append(("code", 0, "\n".join(re.sub(r"^(    |\t)", "", x) for x in lines)))
        elif rows := aligned_table(lines):
            out.append(("table", 0, "\n".join("\t".join(r) for r in rows)))
        elif re.match(r"\s*([-*+•]|\d+[.)])\s+", lines[0]):
            items: list[str] = []
            for x in lines:
                if m := re.match(r"\s*(?:[-*+•]|\d+[.)])\s+(.*)", x):
                    items.append(m[1])
                else:
                    items[-1] += " " + x.strip()
            out += [("item", 0, x) for x in items]
        else:
            out.append(("paragraph", 0, joined(lines)))
    return out


def joined(lines: list[str]) -> str:
    """Hard-wrapped lines as one: a line goes on if it has 60 characters or the next starts in lower case; others stay lines."""
    out = [lines[0].strip()]
    for before, x in zip(lines, lines[1:], strict=False):
        go = len(before.rstrip()) >= 60 or x.strip()[:1].islower()
        out[-1:] = [out[-1] + " " + x.strip()] if go else [out[-1], x.strip()]
    return "\n".join(out)


def front_matter(text: str) -> tuple[dict[str, str], str]:
    """The scalars of a leading block of YAML between --- lines, and what follows."""
    m = re.match(r"---[ \t]*\n(.*?)\n(?:---|\.\.\.)[ \t]*(?:\n|$)", text, re.S)
    if not m:
        return {}, text
    pairs = re.findall(r"^([\w-]+):[ \t]*(.*?)[ \t]*$", m[1], re.M)
    return {k: v.strip("\"'") for k, v in pairs}, text[m.end() :]


def markdown_blocks(text: str) -> list[Block]:
    """Markdown: front matter, headings of both forms, fences, tables, quotes and callouts, lists and tasks, footnotes, rules, paragraphs."""
    meta, text = front_matter(text.replace("\r\n", "\n"))
    out: list[Block] = [("meta", 0, f"{k}={v}") for k, v in meta.items()]
    lines, i = text.split("\n"), 0
    held: list[str] = []

    def close():
        if held:
            out.append(("paragraph", 0, " ".join(x.strip() for x in held)))
            held.clear()

    while i < len(lines):
        x = lines[i]
        if m := re.match(r" {0,3}(`{3,}|~{3,})\s*([\w+#.-]*)", x):
            close()
            body = []
            i += 1
            while i < len(lines) and not re.match(rf" {{0,3}}{re.escape(m[1][0])}{{{len(m[1])},}}\s*$", lines[i]):
                body.append(lines[i])
                i += 1
            out.append((f"code:{m[2]}" if m[2] else "code", 0, "\n".join(body)))
        elif m := re.match(r" {0,3}(#{1,6})(?:\s+(.*?))?(?:\s+#+)?\s*$", x):
            close()
            out.append(("heading", len(m[1]), m[2] or ""))
        elif held and re.match(r" {0,3}(=+|-+)\s*$", x):
            level = 1 if "=" in x else 2
            title = " ".join(y.strip() for y in held)
            held.clear()
            out.append(("heading", level, title))
        elif re.match(r" {0,3}([-*_])(\s*\1){2,}\s*$", x):
            close()
            out.append(("rule", 0, ""))
        elif "|" in x and i + 1 < len(lines) and re.match(r"\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$", lines[i + 1]) and "-" in lines[i + 1]:
            close()
            rows = [cells(x)]
            i += 2
            while i < len(lines) and "|" in lines[i]:
                rows.append(cells(lines[i]))
                i += 1
            out.append(("table", len(rows[0]), "\n".join("\t".join(r) for r in rows)))
            continue
        elif x.lstrip().startswith(">"):
            close()
            body = []
            while i < len(lines) and lines[i].lstrip().startswith(">"):
                body.append(re.sub(r"^\s*>\s?", "", lines[i]))
                i += 1
            if m := re.match(r"\[!(\w+)\][+-]?\s*(.*)", body[0]):
                out.append((f"callout:{m[1].lower()}", 0, " ".join(y for y in [m[2], *body[1:]] if y)))
            else:
                out.append(("quote", 0, "\n".join(body)))
            continue
        elif m := re.match(r"\[\^([^\]]+)\]:\s*(.*)", x):
            close()
            out.append((f"footnote:{m[1]}", 0, m[2]))
        elif m := re.match(r"(\s*)(?:[-*+]|(\d{1,9})[.)])\s+(?:\[([ xX])\]\s+)?(.*)", x):
            close()
            kind = "task" if m[3] == " " else "task:done" if m[3] else "ordered" if m[2] else "item"
            out.append((kind, len(m[1].expandtabs(4)) // 2, m[4]))
        elif x.strip():
            held.append(x)
        else:
            close()
        i += 1
    close()
    return out


def cells(line: str) -> list[str]:
    return [c.replace("\\|", "|").strip() for c in re.split(r"(?<!\\)\|", line.strip().removeprefix("|").removesuffix("|"))]


#: Elements that open a block, that hold no text, and that are furniture with the names that mark it.
BLOCKS = {"p", "div", "section", "article", "main", "blockquote", "pre", "ul", "ol", "li", "table", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "figure", "figcaption", "dl", "dt", "dd", "header", "footer", "nav", "aside", "form", "body", "html", "br", "hr", "details", "summary"}
SILENT = {"script", "style", "noscript", "template", "head", "svg", "iframe", "object"}
FURNITURE = {"nav", "footer", "aside", "form", "header"}
NAMES = r"(?i)(^|[\s_-])(ad|ads|advert\w*|banner|breadcrumbs?|comments?|cookie\w*|footer|menu|nav\w*|newsletter|popup|promo|related|share|sidebar|social|sponsor\w*|subscribe)($|[\s_-])"
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}


class _Page(HTMLParser):
    def __init__(self, keep_furniture: bool):
        super().__init__(convert_charrefs=True)
        self.keep, self.open, self.out, self.text = keep_furniture, [], [], []
        self.skipped = self.hidden = 0
        self.title, self.meta, self.links, self.hidden_text, self.row, self.rows = "", {}, [], [], None, None

    def parse_marked_section(self, i, report=1):
        """A section without a known name is a comment up to the next >; the standard parser raises there."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.parse_bogus_comment(i, report)

    def _mode(self):
        return next((m for _, m in reversed(self.open) if m), None)

    def flush(self):
        text = "".join(self.text)
        self.text.clear()
        tags = [t for t, _ in self.open]
        if "pre" in tags:
            if text.strip():
                self.out.append(("code", 0, text.strip("\n")))
            return
        text = re.sub(r"\s+", " ", text).strip()
        if not text or self._mode():
            return
        if self.row is not None:
            self.row[-1:] = [f"{self.row[-1]} {text}".strip()] if self.row else [text]
            return
        heading = next((t for t in reversed(tags) if re.fullmatch("h[1-6]", t)), None)
        if heading:
            self.out.append(("heading", int(heading[1]), text))
        elif "li" in tags:
            self.out.append(("ordered" if [t for t in tags if t in ("ul", "ol")][-1:] == ["ol"] else "item", sum(t in ("ul", "ol") for t in tags) - 1, text))
        elif "blockquote" in tags:
            self.out.append(("quote", 0, text))
        elif "figcaption" in tags:
            self.out.append(("caption", 0, text))
        elif "dt" in tags or "dd" in tags:
            self.out.append(("term" if "dt" in tags else "definition", 0, text))
        else:
            self.out.append(("paragraph", 0, text))

    def handle_starttag(self, tag, attrs):
        from tessera.functions.predicates import hidden

        a = {k: v or "" for k, v in attrs}
        if tag == "meta" and (name := a.get("name") or a.get("property")):
            self.meta.setdefault(name.lower(), a.get("content", ""))
        if tag == "link" and a.get("rel") == "canonical":
            self.meta["canonical"] = a.get("href", "")
        if tag == "html" and a.get("lang"):
            self.meta["lang"] = a["lang"]
        if tag == "a" and a.get("href") and not self._mode():
            self.links.append(a["href"])
        if tag in BLOCKS:
            self.flush()
        if tag == "img" and not self._mode() and (a.get("alt") or a.get("src")):
            self.out.append(("image", 0, f"{a.get('alt', '')}|{a.get('src', '')}"))
        if tag == "table" and not self._mode() and self.rows is None:
            self.rows = []
        if tag == "tr" and self.rows is not None:
            self.row = []
        if tag in ("td", "th") and self.row is not None:
            self.row.append("")
        if tag in VOID:
            return
        mode = None
        if tag in SILENT:
            mode = "silent"
        elif hidden(a.get("style", ""), " ".join(f'{k}="{v}"' for k, v in a.items())):
            mode, self.hidden = "hidden", self.hidden + 1
        elif not self.keep and tag not in ("html", "body", "main", "article") and (tag in FURNITURE and not (tag == "header" and any(t == "article" for t, _ in self.open)) or re.search(NAMES, f"{a.get('class', '')} {a.get('id', '')}") or a.get("role") in ("navigation", "banner", "contentinfo", "complementary")):
            mode, self.skipped = "furniture", self.skipped + 1
        self.open.append((tag, mode))

    def handle_endtag(self, tag):
        if tag in BLOCKS or tag in SILENT:
            self.flush()
        if tag == "tr" and self.row is not None:
            self.rows.append(self.row)
            self.row = None
        if tag == "table" and self.rows is not None:
            rows, self.rows, self.row = [r for r in self.rows if any(r)], None, None
            if layout(rows):
                self.out += [("paragraph", 0, c) for r in rows for c in r if c]
            else:
                self.out.append(("table", max(map(len, rows)), "\n".join("\t".join(r) for r in rows)))
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        if any(t == "title" for t, _ in self.open) and not any(t == "svg" for t, _ in self.open):
            self.title += data
        mode = self._mode()
        if mode is None:
            self.text.append(data)
        elif mode == "hidden" and data.strip():
            self.hidden_text.append(data.strip())


def layout(rows: list[list[str]]) -> bool:
    """Whether a table only arranges its cells: one row or one column, or cells of long text."""
    if not rows or len(rows) < 2 or max(map(len, rows)) < 2:
        return True
    texts = [c for r in rows for c in r if c]
    return sum(map(len, texts)) > 300 * len(texts)


def html_blocks(html: str, keep_furniture: bool = False) -> list[Block]:
    """Blocks of a page's visible content, without navigation, footers, advertisements and what is hidden; with them, where nothing else is left."""
    page = parsed(html, keep_furniture)
    if not page.out and not keep_furniture:
        return html_blocks(html, True)
    return page.out


def parsed(html: str, keep_furniture: bool = False) -> _Page:
    page = _Page(keep_furniture)
    page.feed(html)
    page.close()
    page.flush()
    return page


def page_facts(html: str) -> list[tuple]:
    """[(title, description, language, canonical, headings, paragraphs, items, tables, links, hidden, furniture, characters)] of a page.
    The title is og:title, else the first h1, else <title> without its site's name."""
    page = parsed(html)
    count = lambda *kinds: sum(k in kinds for k, _, _ in page.out)
    first = next((t for k, n, t in page.out if k == "heading" and n == 1), None)
    title = page.meta.get("og:title") or first or re.sub(r"\s+[|–—-]\s+[^|–—-]{1,40}$", "", re.sub(r"\s+", " ", page.title).strip()) or None
    return [(title, page.meta.get("description") or page.meta.get("og:description"), page.meta.get("lang"), page.meta.get("canonical"), count("heading"), count("paragraph"), count("item", "ordered"), count("table"), len(page.links), page.hidden, page.skipped, sum(len(t) for _, _, t in page.out))]


FACTS = "title string, description string, lang string, canonical string, headings int, paragraphs int, items int, tables int, links int, hidden int, furniture int, chars int"


def link_density(html: str) -> float:
    """The share of a page's visible characters that stand in links."""
    anchors = [re.sub(r"\s+", " ", " ".join(t for _, _, t in parsed(x, True).out)) for x in re.findall(r"(?is)<a\b[^>]*>.*?</a>", html)]
    whole = sum(len(t) for _, _, t in parsed(html, True).out)
    return round(sum(map(len, anchors)) / whole, 6) if whole else 0.0


def one_title(blocks: list[Block]) -> list[Block]:
    """Where several headings are of level 1, all but the first, and what is below them, go down one level."""
    if sum(k == "heading" and n == 1 for k, n, _ in blocks) < 2:
        return blocks
    first = next(i for i, (k, n, _) in enumerate(blocks) if k == "heading" and n == 1)
    return [(k, min(6, n + 1), t) if k == "heading" and i != first else (k, n, t) for i, (k, n, t) in enumerate(blocks)]


def mail_blocks(text: str, mode: str = "mark") -> list[Block]:
    """A plain mail: paragraphs, quotes with their depth, the reply's history and the signature. mode strip drops history and signature; keep makes all paragraphs."""
    out: list[Block] = []
    history = signature = False
    for line in strings.unflow(text):
        kind = strings.mail_line(line)
        if kind == "signature" and not history:
            signature = True
            continue
        if kind in ("reply_header", "original"):
            history = True
            out.append(("history_header", 0, line.strip()))
            continue
        depth = strings.quote_depth(line)
        role = "signature" if signature else "history" if history else "quote" if depth else "paragraph"
        body = re.sub(r"^(>\s?)+", "", line).rstrip()
        if not body:
            out.append(("", 0, ""))
        elif out and out[-1][:2] == (role, depth):
            out[-1] = (role, depth, out[-1][2] + "\n" + body)
        else:
            out.append((role, depth, body))
    out = [b for b in out if b[0]]
    if mode == "strip":
        return [b for b in out if b[0] not in ("history", "history_header", "signature")]
    return [("paragraph", 0, t) for _, _, t in out] if mode == "keep" else out
