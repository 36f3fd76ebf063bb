"""Predicates over files, pages, options and callers."""

from __future__ import annotations

import fnmatch
import ipaddress
import json
import re

#: What begins an executable file, and file extensions by media type.
EXECUTABLE = (b"MZ", b"\x7fELF", b"\xfe\xed\xfa\xce", b"\xfe\xed\xfa\xcf", b"\xce\xfa\xed\xfe", b"\xcf\xfa\xed\xfe", b"\xca\xfe\xba\xbe")
EXTENSIONS = {"text/plain": "txt log", "text/markdown": "md markdown", "text/html": "html htm", "text/csv": "csv", "application/json": "json", "application/pdf": "pdf", "application/zip": "zip docx xlsx pptx odt ods odp epub jar", "application/gzip": "gz tgz", "image/png": "png", "image/jpeg": "jpg jpeg", "application/xml": "xml svg"}


def mime_matches(pattern: str, mime: str) -> bool:
    """`type/subtype` with * for either part; parameters and case don't count."""
    a, b = (x.split(";")[0].strip().lower().partition("/") for x in (pattern, mime))
    return a[0] in ("*", b[0]) and a[2] in ("*", b[2])


def executable(head: bytes) -> bool:
    """By magic. A Java class shares the mark of fat Mach-O files; its version tells them apart, and neither is a document."""
    return head.startswith(EXECUTABLE) or head[:2] == b"#!"


def mismatches(name: str, declared: str, detected: str) -> list[str]:
    """Codes where a file's declared type or extension contradicts its content."""
    found = []
    if declared and declared.split(";")[0].strip().lower() not in ("application/octet-stream", detected):
        found.append("declared-type-differs")
    extension = name.lower().rpartition(".")[2] if "." in name else ""
    if extension and detected in EXTENSIONS and extension not in EXTENSIONS[detected].split() and any(extension in x.split() for x in EXTENSIONS.values()):
        found.append("extension-differs")
    return found


def _rule(pattern: str) -> tuple[re.Pattern, bool, bool]:
    """(expression over a path inside the rule's directory, negated, for directories only) of a line of a .gitignore."""
    negated = pattern.startswith("!")
    pattern = pattern[negated:].removeprefix("\\")
    only_dirs = pattern.endswith("/")
    body = pattern.strip("/")
    out = "" if "/" in pattern.rstrip("/") else "(?:.*/)?"
    i = 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("/**", i) and i + 3 == len(body):
            out, i = out + "/.+", i + 3
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        elif body[i] == "[" and (end := body.find("]", i + 2)) > 0:
            out, i = out + "[" + body[i + 1 : end].replace("!", "^", 1) + "]", end + 1
        else:
            out, i = out + re.escape(body[i]), i + 1
    return re.compile(out), negated, only_dirs


def ignored(path: str, rules: str) -> bool:
    """rules: JSON object of directory ("" for the root) to its .gitignore. The deepest file's last match decides; a directory that is ignored takes all below it."""
    files = json.loads(rules)
    parts = path.split("/")
    for n in range(1, len(parts) + 1):
        at, verdict = "/".join(parts[:n]), None
        for where in sorted((d for d in files if not d or at.startswith(d + "/")), key=lambda d: d.count("/") + bool(d)):
            inside = at[len(where) + 1 :] if where else at
            for line in files[where].split("\n"):
                if line.strip() and not line.startswith("#"):
                    rule, negated, only_dirs = _rule(line.rstrip())
                    if (n < len(parts) or not only_dirs) and rule.fullmatch(inside):
                        verdict = not negated
        if verdict:
            return True
    return False


#: Directories that no pack takes, lock files, and endings of generated files.
SKIPPED = (".git", ".hg", ".svn", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", "target", ".tox", ".mypy_cache", ".pytest_cache", ".idea", ".vscode", "vendor")
LOCKS = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "cargo.lock", "go.sum", "composer.lock", "gemfile.lock", "uv.lock", "pipfile.lock")


def packed(path: str, include: str, exclude: str) -> bool:
    """Whether a repository's pack takes a path: no skipped directory, one of the include globs (all, if none are given), none of the exclude globs."""
    if any(x in SKIPPED for x in path.split("/")[:-1]):
        return False
    hit = lambda globs: any(fnmatch.fnmatch(path, g) or fnmatch.fnmatch(path.rpartition("/")[2], g) for g in globs.split())
    return (not include or hit(include)) and not hit(exclude)


def file_class(path: str, text: str, size: int, most: int = 1_000_000) -> str:
    """secret, binary, too_large, lockfile, minified, generated or source."""
    name = path.rpartition("/")[2].lower()
    if re.fullmatch(r"\.env(\..+)?|id_(rsa|dsa|ecdsa|ed25519)|.*\.(pem|key|p12|pfx|keystore)|credentials(\.json)?|\.netrc|\.npmrc", name) and not name.endswith((".example", ".sample")):
        return "secret"
    if "\0" in text:
        return "binary"
    if size > most:
        return "too_large"
    if name in LOCKS:
        return "lockfile"
    lines = text.split("\n")
    if re.search(r"\.min\.(js|css)$", name) or (len(text) > 5000 and len(text) / len(lines) > 500):
        return "minified"
    if re.search(r"(?i)@generated|do not edit|auto-?generated|code generated by", "\n".join(lines[:10])) or re.search(r"(_pb2\.py|\.pb\.go|\.g\.dart)$", name):
        return "generated"
    return "source"


def script_shell(script_bytes: int, html_bytes: int, roots: int, visible: int) -> bool:
    """Whether a page shows nothing without its scripts: hardly any visible text, and an application's root or mostly script."""
    return visible < 200 and (roots > 0 or (html_bytes > 0 and script_bytes > 0.5 * html_bytes))


def paywalled(html: str, visible: int) -> bool:
    """Under 600 visible characters with a sign of a paywall: JSON-LD, a class or id, or a phrase."""
    signs = r'(?is)"isAccessibleForFree"\s*:\s*("?false"?)|(class|id)="[^"]*\b(paywall|subscriber-only|premium-content|metered)\b|\b(subscribe to (continue|read)|subscribers only|to continue reading)\b'
    return visible < 600 and re.search(signs, html) is not None


def fallback_reason(got: int, page: int) -> str | None:
    """Why an extractor's text is too little: under 200 characters, or under a quarter of the page's; 90 % of the page is always enough."""
    if page and got >= 0.9 * page:
        return None
    return "short" if got < 200 else "small share" if got < 0.25 * page else None


def grounded(quote: str, answer: str, text: str) -> bool:
    """Whether every word of an answer is in the text, and its quote is, verbatim or in four of five of its words."""
    words = lambda x: re.findall(r"[a-z0-9]+", x.lower())
    known, wanted = set(words(text)), words(quote)
    if not wanted or not set(words(answer)) <= known:
        return False
    return quote in text or sum(w in known for w in wanted) >= 0.8 * len(wanted)


def coerce(value: str, kind: str) -> str | None:
    """An option's text as JSON of its kind: bool, int, float, optional kinds with ?, or a|b|c for one of these; null if it doesn't fit."""
    if kind.endswith("?"):
        return "null" if value.lower() in ("", "none", "null") else coerce(value, kind[:-1])
    if kind == "bool":
        low = value.lower()
        return "true" if low in ("1", "true", "yes", "on") else "false" if low in ("0", "false", "no", "off") else None
    try:
        if kind == "int":
            return json.dumps(int(value))
        if kind == "float":
            return json.dumps(float(value), allow_nan=False)
    except ValueError:
        return None
    if "|" in kind:
        return json.dumps(value) if value in kind.split("|") else None
    return json.dumps(value)


def hidden(style: str, attributes: str) -> str | None:
    """Why an element isn't seen: its style, class, aria-hidden, the hidden attribute, or an input of that type."""
    css = {k.strip().lower(): v.strip().lower() for k, _, v in (x.partition(":") for x in style.split(";")) if k.strip()}
    if css.get("display") == "none":
        return "display"
    if css.get("visibility") in ("hidden", "collapse"):
        return "visibility"
    if re.fullmatch(r"0*(\.0+)?", css.get("opacity", "1")):
        return "opacity"
    if re.fullmatch(r"0(px|pt|em|rem|%)?", css.get("font-size", "")):
        return "font-size"
    if css.get("position") in ("absolute", "fixed") and any(re.fullmatch(r"-\d{4,}px", css.get(k, "")) for k in ("left", "top", "text-indent")):
        return "off-screen"
    if css.get("color") and css.get("color") == css.get("background-color", css.get("background")):
        return "color"
    low = attributes.lower()
    if re.search(r"\baria-hidden\s*=\s*[\"']?true", low):
        return "aria"
    if re.search(r"(^|\s)hidden(\s|=|$)", low) or re.search(r"\btype\s*=\s*[\"']?hidden", low):
        return "attribute"
    return "class" if re.search(r"\bclass\s*=\s*[\"'][^\"']*\b(sr-only|visually-hidden|hidden|d-none)\b", low) else None


def allows(rules: str, ip: str, agent: str) -> bool:
    """rules: JSON {"networks": [...], "agents": [globs]}; an empty or absent list allows all."""
    spec = json.loads(rules)
    try:
        at = ipaddress.ip_address(ip)
    except ValueError:
        return False
    near = not spec.get("networks") or any(at in ipaddress.ip_network(n, strict=False) for n in spec["networks"])
    return near and (not spec.get("agents") or any(fnmatch.fnmatch(agent, g) for g in spec["agents"]))


def queue_for(mime: str, url: str) -> str:
    """The queue of a job: fetch for URLs, media for sound and moving pictures, heavy for PDF and office files, else light."""
    if url:
        return "fetch"
    if mime.startswith(("audio/", "video/")):
        return "media"
    return "heavy" if mime == "application/pdf" or re.search(r"officedocument|opendocument|msword|ms-excel|ms-powerpoint", mime) else "light"


def outcome(status: str, code: str) -> str:
    """ok, declared (a failure that the converter names) or bug."""
    return "ok" if status == "ok" else "declared" if code and code not in ("internal", "crash", "timeout") else "bug"


#: What an exception's kind means to a caller: (exit code, stable code).
FAILURES = {"FileNotFoundError": (2, "not_found"), "PermissionError": (2, "forbidden"), "UnsupportedType": (3, "unsupported"), "LimitExceeded": (4, "limit"), "TimeoutError": (5, "timeout"), "ValueError": (6, "invalid")}


def failure(kind: str) -> str:
    exit_code, code = FAILURES.get(kind, (1, "internal"))
    return f"{exit_code} {code}"
