"""Blocks to Markdown: headings, tables, chunks, pages, offsets, notes."""

from __future__ import annotations

import html as html_
import json
import re

from tessera.documents.blocks import Block
from tessera.functions import dates, strings


def tokens(text: str) -> int:
    """An estimate without a tokenizer: length / 3.8, or / 1.6 where four in five letters are CJK; ties to even, 1 at least, 0 for none."""
    if not text:
        return 0
    letters = sum(c.isalpha() for c in text)
    wide = len(re.findall("[぀-ヿ㐀-䶿一-鿿가-힯]", text))
    return max(1, round(len(text) / (1.6 if wide and wide >= 0.8 * letters else 3.8)))


def heading_plan(levels: list[int]) -> list[list]:
    """[effective level, number, anchor] of headings by their source levels: one below the open heading above, 2 on top; numbers count per level."""
    out, open_, counts = [], [], [0] * 64
    for level in levels:
        while open_ and open_[-1] >= level:
            open_.pop()
        open_.append(level)
        depth = len(open_)
        counts[depth] += 1
        counts[depth + 1 :] = [0] * (63 - depth)
        number = ".".join(str(counts[d]) for d in range(1, depth + 1))
        out.append([depth + 1, number, "sec-" + number.replace(".", "-")])
    return out


def numeric(values: list[str]) -> bool:
    """Whether every cell that isn't empty reads as a number."""
    found = [v for v in values if v.strip()]
    return bool(found) and all(re.fullmatch(r"\(?[+-]?[$€£]?\s*(\d{1,3}(,\d{3})+|\d+)?(\.\d+)?\s*%?\)?", v.strip()) and re.search(r"\d", v) for v in found)


def representation(rows: int, columns: int, merged: bool = False, cap: int = 200, compact: bool = False) -> str:
    """html for merged cells, sampled above 1,000 rows (compact: five caps), kv above six columns or the cap, else pipe."""
    if merged and not compact:
        return "html"
    if rows > 1000 or (compact and rows > 5 * cap):
        return "sampled"
    return "kv" if columns > 6 or rows > cap else "pipe"


def attached(rows: int, columns: int, form: str, always: bool = False) -> bool:
    """Whether a table also goes out as CSV."""
    return always or columns > 6 or rows > 50 or form == "sampled"


def _cell(text: str) -> str:
    return re.sub(r"\s*\r?\n\s*", "<br>", re.sub(r"([|\\])", r"\\\1", text.strip()))


def with_header(rows: list[list[str]]) -> tuple[list[str], list[list[str]]]:
    """Header and body: the first row if it is full, without numbers, and some number stands below; else made-up names."""
    if len(rows) > 1 and all(c.strip() for c in rows[0]) and not any(numeric([c]) for c in rows[0]) and any(numeric([c]) for r in rows[1:] for c in r):
        return rows[0], rows[1:]
    return [f"Column {i + 1}" for i in range(max(map(len, rows), default=0))], rows


def pipe_table(rows: list[list[str]], declared: bool = False) -> str:
    """A pipe table; columns after the first whose cells are numbers are right-aligned."""
    header, body = (rows[0], rows[1:]) if declared else with_header(rows)
    body = [[*r, *[""] * (len(header) - len(r))] for r in body]
    marks = ["---:" if i and numeric([r[i] for r in body]) else "---" for i in range(len(header))]
    return "\n".join("| " + " | ".join(map(_cell, r)) + " |" for r in [header, marks, *body])


def key_values(rows: list[list[str]], declared: bool = True) -> str:
    """A line a row: `- **first**: name: value; ...`, empty cells left out."""
    header, body = (rows[0], rows[1:]) if declared else with_header(rows)
    return "\n".join(f"- **{r[0]}**: " + "; ".join(f"{h}: {v}" for h, v in zip(header[1:], r[1:], strict=False) if v.strip()) for r in body)


def html_table(cells: list[list]) -> str:
    """cells: [row, column, row span, column span, header, text]."""
    out, rows = [], sorted({c[0] for c in cells})
    for r in rows:
        line = ""
        for _, _, down, across, head, text in sorted((c for c in cells if c[0] == r), key=lambda c: c[1]):
            tag = "th" if head else "td"
            spans = (f' rowspan="{down}"' if down > 1 else "") + (f' colspan="{across}"' if across > 1 else "")
            line += f"<{tag}{spans}>{html_.escape(text)}</{tag}>"
        out.append(f"<tr>{line}</tr>")
    return "<table>" + "".join(out) + "</table>"


def sampled(rows: list[list[str]], head: int = 20, tail: int = 5) -> str:
    """A pipe table of the first and last rows, with how many are left out."""
    if len(rows) - 1 <= head + tail:
        return pipe_table(rows, True)
    lines = pipe_table([rows[0], *rows[1 : head + 1], *rows[-tail:]], True).split("\n")
    note = f"| … {len(rows) - 1 - head - tail} rows omitted |" + " |" * (len(rows[0]) - 1)
    return "\n".join([*lines[: 2 + head], note, *lines[2 + head :]])


def change(mode: str, kind: str, old: str, new: str) -> str:
    """A tracked change: accept, reject, annotate (CriticMarkup) or drop."""
    if mode == "annotate":
        return {"insert": f"{{++{new}++}}", "delete": f"{{--{old}--}}", "replace": f"{{~~{old}~>{new}~~}}", "comment": f"{{>>{new}<<}}"}[kind]
    if kind == "comment" or mode == "drop":
        return ""
    return (new if kind != "delete" else "") if mode == "accept" else (old if kind != "insert" else "")


def unit_text(block: Block, plan: list | None = None) -> str:
    kind, level, text = block
    if kind == "heading":
        depth, number = (plan[0], plan[1]) if plan else (level + 1, "")
        head = f"{number} {strings.without_number(text)}".strip()
        return f"{'#' * depth} {head}" if depth <= 6 else f"**{head}**"
    if kind.startswith("code"):
        return strings.fence(text, kind.partition(":")[2])
    if kind == "table":
        rows = [r.split("\t") for r in text.split("\n")]
        form = representation(len(rows) - 1, max(map(len, rows)))
        return sampled(rows) if form == "sampled" else key_values(rows) if form == "kv" else pipe_table(rows, True)
    if kind == "quote":
        return "\n".join("> " + x if x else ">" for x in text.split("\n"))
    marks = {"item": "- ", "ordered": "1. ", "task": "- [ ] ", "task:done": "- [x] "}
    if kind in marks:
        return "  " * level + marks[kind] + text
    if kind == "rule":
        return "---"
    if kind == "image":
        alt, _, src = text.partition("|")
        return f"![{alt}]({src})"
    return text


def units(blocks: list[Block]) -> list[dict]:
    """Rendered units in reading order: {kind, text, tokens, path, start, end} with byte offsets in the body that joins them by blank lines; items of one list
    follow each other by a single line."""
    plan = iter(heading_plan([n for k, n, _ in blocks if k == "heading"]))
    out, path, at, last = [], [], 0, None
    for b in blocks:
        if b[0] == "meta":
            continue
        own = next(plan) if b[0] == "heading" else None
        text = unit_text(b, own)
        if own:
            path = [*path[: own[0] - 2], strings.without_number(b[2])]
        tight = b[0] in ("item", "ordered", "task", "task:done")
        if out:
            at += 1 if tight and last else 2
        size = len(text.encode())
        out.append({"kind": b[0].partition(":")[0], "text": text, "tokens": tokens(text), "path": list(path), "start": at, "end": at + size, "glue": "\n" if tight and last and out else "\n\n"})
        at, last = at + size, tight
    return out


def body(found: list[dict]) -> str:
    return "".join((u["glue"] if i else "") + u["text"] for i, u in enumerate(found))


def sections(found: list[dict]) -> list[list]:
    """[title, first byte, end byte, tokens] of the section of each heading; what stands before the first is the preamble, with no title."""
    out: list[list] = []
    for u in found:
        if u["kind"] == "heading" or not out:
            out.append([u["path"][-1] if u["kind"] == "heading" else None, u["start"], u["end"], 0])
        out[-1][2] = u["end"]
        out[-1][3] += u["tokens"]
    return out


def _pieces(u: dict, budget: int) -> list[dict]:
    """A unit over the budget: prose by sentences, tables by rows under their header when over four budgets; other kinds stand alone."""
    if u["tokens"] <= budget or u["kind"] not in ("paragraph", "table") or (u["kind"] == "table" and u["tokens"] <= 4 * budget):
        return [u]
    head, parts, glue = ("", strings.sentences(u["text"]), " ") if u["kind"] == "paragraph" else ("\n".join(u["text"].split("\n")[:2]) + "\n", u["text"].split("\n")[2:], "\n")
    out = [head + parts[0]]
    for p in parts[1:]:
        out[-1:] = [out[-1] + glue + p] if tokens(out[-1] + glue + p) <= budget else [out[-1], head + p]
    return [{**u, "text": t, "tokens": tokens(t)} for t in out]


def chunks(found: list[dict], title: str = "", budget: int = 400, least: int = 100, overlap: int = 0) -> list[list]:
    """[number, breadcrumb, text, tokens, oversized] of chunks: a section a chunk, short sections go on into the next while both fit, long ones are packed.
    A unit costs its tokens and 1; a chunk is charged with its breadcrumb and 2."""
    parts: list[list[dict]] = []
    for u in found:
        if u["kind"] == "heading" or not parts:
            parts.append([])
        parts[-1].append(u)
    cost = lambda us: sum(u["tokens"] + 1 for u in us)
    merged: list[list[dict]] = []
    for p in parts:
        if merged and cost(merged[-1]) < least and cost(merged[-1]) + cost(p) <= budget:
            merged[-1] = merged[-1] + p
        else:
            merged.append(p)
    out: list[list] = []
    for p in merged:
        crumb = " > ".join(x for x in [title, *p[0]["path"]] if x)
        room = budget - (tokens(f"**{crumb}**") + 2 if crumb else 0)
        held: list[dict] = []
        for u in (y for x in p for y in _pieces(x, room)):
            if held and cost(held) + u["tokens"] + 1 > room:
                out.append([crumb, held])
                held = []
            held.append(u)
        if held:
            out.append([crumb, held])
    rows = []
    for no, (crumb, us) in enumerate(out, 1):
        text = "".join((u["glue"] if i else "") + u["text"] for i, u in enumerate(us))
        if overlap and rows and rows[-1][1] == crumb:
            text = (tail(rows[-1][2], overlap) + "\n\n" + text).strip()
        rows.append([no, crumb, text, tokens(text), tokens(text) > budget])
    return rows


def tail(text: str, most: int) -> str:
    """Whole closing sentences of a text within `most` tokens."""
    kept = ""
    for s in reversed(strings.sentences(text)):
        if tokens(f"{s} {kept}".strip()) > most:
            break
        kept = f"{s} {kept}".strip()
    return kept


def page_of(found: list[dict], start: int, budget: int) -> list[int]:
    """[first unit, unit after the last] of a page: the longest run within the budget, cut back to its last heading, one unit at least."""
    at, spent = start, 0
    while at < len(found) and (at == start or spent + found[at]["tokens"] + 1 <= budget):
        spent += found[at]["tokens"] + 1
        at += 1
    if at < len(found):
        heads = [i for i in range(start + 1, at) if found[i]["kind"] == "heading"]
        at = heads[-1] if heads else at
    return [start, at]


def segments(text: str, size: int) -> list[str]:
    """Pieces of about `size` tokens, cut at lines; a tail under a quarter goes to the piece before."""
    out, held = [], ""
    for line in text.splitlines(keepends=True):
        if held and tokens(held + line) > size:
            out.append(held)
            held = ""
        held += line
    if held and out and tokens(held) < size / 4:
        out[-1] += held
    elif held:
        out.append(held)
    return out


def cut_tokens(text: str, limit: int) -> str:
    """The longest beginning within the limit, cut back to its last line end if that lies past its middle."""
    low, high = 0, len(text)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if tokens(text[:mid]) <= limit else (low, mid - 1)
    at = text.rfind("\n", 0, low)
    return text[: at + 1] if low < len(text) and at > low / 2 else text[:low]


def fit_lines(counts: list[list[int]], room: int, least: int = 40) -> int:
    """The most lines that every file may keep so that their tokens fit. counts: [lines, tokens] of each file; `least` if nothing fits."""
    low, high = least, max((n for n, _ in counts), default=least)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if sum(t * min(n, mid) / max(n, 1) for n, t in counts) <= room else (low, mid - 1)
    return low


def footnotes(text: str, notes: dict[str, str], mode: str) -> str:
    """References numbered by first use; notes at the end, inline or dropped."""
    order: list[str] = []

    def number(m):
        if m[1] not in notes:
            return m[0]
        if m[1] not in order:
            order.append(m[1])
        return {"inline": f" ({notes[m[1]]})", "drop": ""}.get(mode, f"[^{order.index(m[1]) + 1}]")

    out = re.sub(r"\[\^([^\]]+)\]", number, text)
    return out + "".join(f"\n\n[^{i}]: {notes[k]}" for i, k in enumerate(order, 1)) if mode == "end" else out


def title_of(meta: str | None, blocks: list[Block], stem: str) -> str:
    """The metadata's title, else the first heading of level 1, else the file's stem."""
    return meta or next((t for k, n, t in blocks if k == "heading" and n == 1), None) or stem


def wrapped(text: str, source: str, risk: str) -> str:
    """A fence for content that isn't trusted, with an identifier that follows from it."""
    from tessera.functions.jsons import fence_id

    return f'<untrusted id="{fence_id(text)}" source="{html_.escape(source)}" risk="{risk}">\n{strings.defang(text)}\n</untrusted>'


def contents(found: list[dict]) -> str:
    """A list of links to the headings, for five or more of them or over 3,000 tokens; else nothing."""
    heads = [u for u in found if u["kind"] == "heading"]
    if len(heads) < 5 and sum(u["tokens"] for u in found) <= 3000:
        return ""
    plan = heading_plan([len(u["path"]) for u in heads])
    return "\n".join(f"{'  ' * (len(u['path']) - 1)}- [{u['path'][-1]}](#{p[2]})" for u, p in zip(heads, plan, strict=True))


def prometheus(rows: list[list]) -> str:
    """[name, kind, help, labels as JSON, value] as a text exposition, a head for each name."""
    out, seen = [], set()
    for name, kind, help_, labels, value in rows:
        if name not in seen:
            seen.add(name)
            out += [f"# HELP {name} {help_}", f"# TYPE {name} {kind}"]
        shown = ",".join(f'{k}="{json.dumps(str(v))[1:-1]}"' for k, v in sorted(json.loads(labels).items()))
        out.append(f"{name}{{{shown}}} {value:g}" if shown else f"{name} {value:g}")
    return "\n".join(out) + "\n"


def tidy_money(rows: list[list[str]]) -> list[list[str]]:
    """Financial tables: a column that holds currency signs alone joins the next one, one of closing brackets or per cent signs the one before; empty ones go."""
    width = max(map(len, rows), default=0)
    rows = [[*r, *[""] * (width - len(r))] for r in rows]
    for i in reversed(range(width)):
        own = {r[i].strip() for r in rows} - {""}
        if own and own <= {"$", "US$", "EUR", "GBP", "JPY", "€", "£", "¥"} and i + 1 < width:
            rows = [[*r[:i], (r[i].strip() + r[i + 1].strip()) if r[i + 1].strip() else "", *r[i + 2 :]] for r in rows]
        elif own and own <= {")", "%", ")%"} and i:
            rows = [[*r[: i - 1], r[i - 1].strip() + r[i].strip(), *r[i + 1 :]] for r in rows]
        elif not own:
            rows = [[*r[:i], *r[i + 1 :]] for r in rows]
        width = max(map(len, rows), default=0)
    return rows


def serial_note(value: float) -> str | None:
    return dates.serial_date(value)
