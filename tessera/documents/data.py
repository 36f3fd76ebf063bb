"""Delimited text, JSON, XML, YAML and TOML as rows."""

from __future__ import annotations

import csv
import io
import json
import re
import tomllib
from collections import Counter
from xml.etree import ElementTree

from tessera.functions import dates

MAX_ROWS, MAX_COLUMNS = 10_000, 256


def delimiter(text: str) -> str:
    """Of comma, semicolon, tab and bar the one whose rows agree best on a number of fields above one; comma if none does."""
    best = (0.0, 0, 0, ",")
    for place, mark in enumerate(",;\t|"):
        rows = [r for r in csv.reader(io.StringIO(text[:65536]), delimiter=mark) if r]
        if rows:
            width, n = Counter(map(len, rows)).most_common(1)[0]
            if width > 1:
                best = max(best, (n / len(rows), width, -place, mark))
    return best[3]


def _kind(cell: str, comma: bool) -> str | None:
    cell = cell.strip()
    if not cell:
        return None
    number = cell.replace(",", ".") if comma else cell
    if re.fullmatch(r"[+-]?\d+", cell):
        return "int"
    if re.fullmatch(r"[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?", number):
        return "float"
    if re.fullmatch(r"[+-]?\d+(\.\d+)?\s?%", number):
        return "percent"
    if dates.iso_date(cell):
        return "date"
    return "bool" if cell.lower() in ("true", "false", "yes", "no") else "text"


def merged(kinds: list[str | None]) -> str:
    """One type wins; int and float are float; else text. Empty cells don't vote."""
    found = {k for k in kinds if k}
    return found.pop() if len(found) == 1 else "float" if found == {"int", "float"} else "text"


def has_header(rows: list[list[str]], comma: bool = False) -> bool:
    """Whether the first row names columns: full, no number in it, different names, and some typed cell below (or none typed at all, with short names)."""
    if len(rows) < 2 or not all(x.strip() for x in rows[0]) or len(set(rows[0])) < len(rows[0]):
        return False
    if any(_kind(x, comma) not in ("text",) for x in rows[0]):
        return False
    below = [[_kind(r[i], comma) if i < len(r) else None for r in rows[1:]] for i in range(len(rows[0]))]
    return any(merged(k) != "text" for k in below) or all(len(x) <= 40 for x in rows[0])


def read_csv(text: str) -> dict:
    """{delimiter, header, columns: [[name, type]], rows, ragged, omitted}: rows padded or joined to the header's width, under caps that are reported."""
    text = text.removeprefix("﻿")
    mark = delimiter(text)
    rows = [r for r in csv.reader(io.StringIO(text), delimiter=mark) if any(x.strip() for x in r)]
    comma = mark == ";"
    header = has_header(rows, comma)
    width = len(rows[0]) if header else Counter(map(len, rows)).most_common(1)[0][0] if rows else 0
    body, ragged = [], 0
    for r in rows[header:]:
        ragged += len(r) != width
        body.append(r + [""] * (width - len(r)) if len(r) <= width else [*r[: width - 1], mark.join(r[width - 1 :])])
    names = rows[0] if header else [f"column_{i + 1}" for i in range(width)]
    kinds = [merged([_kind(r[i], comma) for r in body]) for i in range(min(width, MAX_COLUMNS))]
    return {"delimiter": mark, "header": header, "columns": [list(x) for x in zip(names, kinds, strict=False)], "rows": [r[:MAX_COLUMNS] for r in body[:MAX_ROWS]], "ragged": ragged, "omitted": max(0, len(body) - MAX_ROWS)}


def read_json(text: str) -> dict:
    """{form, values, bad}: a whole document, else JSON lines with the numbers of lines that are none."""
    try:
        return {"form": "document", "values": [json.loads(text)], "bad": []}
    except ValueError:
        values, bad = [], []
        for no, line in enumerate(text.split("\n"), 1):
            if line.strip():
                try:
                    values.append(json.loads(line))
                except ValueError:
                    bad.append(no)
        return {"form": "lines" if values else "none", "values": values, "bad": bad}


def read_xml(text: str) -> list[list]:
    """[path, occurrences, attributes, first text] of each element path; document types and entities are removed, never resolved."""
    text = re.sub(r"<!DOCTYPE[^>\[]*(\[.*?\])?[^>]*>", "", text, flags=re.S | re.I)
    text = re.sub(r"&(?!(amp|lt|gt|quot|apos|#\d+|#x[0-9a-fA-F]+);)[\w.-]+;", "", text)
    found: dict[str, list] = {}

    def walk(node, path):
        at = f"{path}/{re.sub(r'{.*}', '', node.tag)}"
        row = found.setdefault(at, [at, 0, set(), None])
        row[1] += 1
        row[2] |= {"@" + re.sub(r"{.*}", "", k) for k in node.attrib}
        row[3] = row[3] or (node.text or "").strip() or None
        for child in node:
            walk(child, at)

    walk(ElementTree.fromstring(text), "")
    return [[p, n, sorted(a), t] for p, n, a, t in found.values()]


def read_yaml(text: str) -> list[str]:
    """Each document as JSON, scalars as they are spelled; tags make no objects."""
    import yaml

    class Verbatim(yaml.SafeLoader):
        pass

    Verbatim.yaml_implicit_resolvers = {}
    Verbatim.add_multi_constructor("", lambda loader, suffix, node: loader.construct_scalar(node) if isinstance(node, yaml.ScalarNode) else loader.construct_sequence(node, True) if isinstance(node, yaml.SequenceNode) else loader.construct_mapping(node, True))
    return [json.dumps(x, ensure_ascii=False) for x in yaml.load_all(text, Verbatim)]


def read_toml(text: str) -> str:
    return json.dumps(tomllib.loads(text), ensure_ascii=False, default=str)
