"""Text functions over columns: cleaning, tokens, numbers, URLs, redaction. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The space separators of Unicode (category Zs), which DuckDB's trim takes off.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
_CJK = r"[぀-ヿ㐀-䶿一-鿿가-힯]"


def _as(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def token_estimate(text: Column | str) -> Column:
    """Tokens without a tokenizer: 0 for none, else length / 3.8 (/ 1.6 where four in five letters are CJK), half to even, 1 at least."""
    text = _as(text)
    n = F.length(text)
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    wide = F.when(text.rlike(_CJK), F.regexp_count(text, F.lit(_CJK)) >= letters * 0.8).otherwise(F.lit(False))
    per = F.when(wide, F.lit(1.6)).otherwise(F.lit(3.8))
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.bround(n / per).cast("int"))).cast("bigint")


def collapse_whitespace(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(_as(text), r"\s+", " "))


def strip_control(text: Column | str) -> Column:
    """CRLF to LF; control, invisible and direction characters go."""
    lines = F.regexp_replace(_as(text), r"\r\n?", "\n")
    return F.regexp_replace(lines, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F​-‏‪-‮⁠-⁤⁦-⁩﻿]", "")


def slugify(text: Column | str) -> Column:
    """Lower-case ASCII letters and digits joined by hyphens; Latin accents are folded."""
    folded = F.translate(F.lower(_as(text)), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.trim(F.regexp_replace(F.regexp_replace(folded, r"[^\x00-\x7F]", ""), r"[^a-z0-9]+", "-"), F.lit("-"))


def escape_line_start(line: Column | str) -> Column:
    """A backslash where the line would open a heading, quote, list or rule."""
    line = F.regexp_replace(_as(line), r"^(\s{0,3})([#>+*-])(?=\s|$)", r"$1\\$2")
    return F.regexp_replace(line, r"^(\s{0,3}\d{1,9})([.)])(?=\s|$)", r"$1\\$2")


def pipe_cell(text: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(_as(text), r"([|\\])", r"\\$1"), r"\s*\r?\n\s*", "<br>")


def message_shape(text: Column | str, width: int = 80) -> Column:
    """What a message looks like without its particulars: quoted names blanked, digits as #."""
    return F.substring(F.regexp_replace(F.regexp_replace(_as(text), r"'[^']*'|\"[^\"]*\"", "''"), r"[0-9]+", "#"), 1, width)


def normalize_subject(text: Column | str) -> Column:
    """Without Re:, Fwd: and [list] marks, white space collapsed, lower case."""
    return F.lower(collapse_whitespace(F.regexp_replace(_as(text), r"(?i)^(\s*((re|fw|fwd|aw|wg)(\[\d+\])?\s*:|\[[^\]]*\]))+\s*", "")))


def dominant_script(text: Column | str) -> Column:
    """latin, cjk, cyrillic or arabic where that is four fifths of the letters counted, else mixed; none without letters."""
    text = _as(text)
    classes = {"latin": r"[A-Za-zÀ-ɏ]", "cjk": _CJK, "cyrillic": r"[Ѐ-ӿ]", "arabic": r"[؀-ۿ]"}
    counts = {k: F.regexp_count(text, F.lit(v)) for k, v in classes.items()}
    total = sum(counts.values(), F.lit(0))
    best = F.when(total == 0, F.lit("none"))
    for k, n in counts.items():
        best = best.when(n >= total * 0.8, F.lit(k))
    return best.otherwise(F.lit("mixed"))


def parse_number(text: Column | str) -> Column:
    """Display numbers: currency signs, thousands commas, percent, parentheses for negative; null for anything else."""
    t = F.trim(_as(text))
    body = F.regexp_replace(F.regexp_replace(t, r"^\((.*)\)$", "-$1"), r"[$€£¥\s]", "")
    good = body.rlike(r"^[+-]?(\d{1,3}(,\d{3})+|\d+)?(\.\d+)?%?$") & body.rlike(r"\d")
    n = F.regexp_replace(body, r"[,%]", "").try_cast("double")
    return F.when(good, F.when(body.endswith("%"), n / 100).otherwise(n))


def infer_type(text: Column | str) -> Column:
    """The type that one cell votes for; empty cells don't vote."""
    t = F.trim(_as(text))
    return (
        F.when(t.isNull() | (t == ""), F.lit(None).cast("string"))
        .when(t.rlike(r"^[+-]?\d+$"), "int")
        .when(t.rlike(r"^[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?$"), "float")
        .when(t.rlike(r"^[+-]?\d+(\.\d+)?%$"), "percent")
        .when(t.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"), "date")
        .when(F.lower(t).isin("true", "false", "yes", "no"), "bool")
        .otherwise("text")
    )


def strip_tracking(url: Column | str) -> Column:
    """Without utm_* and the other tracking parameters."""
    drop = r"(?i:utm_[^=&#]*|fbclid|gclid|mc_cid|mc_eid|ref|igshid)(?:=[^&#]*)?"
    u = F.regexp_replace(_as(url), rf"([?&]){drop}(?=[&#]|$)", "$1")
    u = F.regexp_replace(u, rf"([?&]){drop}(?=[&#]|$)", "$1")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(u, r"&&+", "&"), r"\?&+", "?"), r"[?&]+(?=#|$)", "")


def html_text(html: Column | str) -> Column:
    """Visible text: scripts, styles, comments and tags go, common entities are decoded, white space collapses."""
    t = F.regexp_replace(_as(html), r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    return collapse_whitespace(t)


def written_title(html: Column | str) -> Column:
    """The title as a page's markup has it, references and all: the first h1 of text alone, or <title> where there is no h1, without spaces around."""
    html = _as(html)
    h1 = F.regexp_extract(html, r"<h1[^>]*+>([^<]*+)</h1>", 1)
    return F.btrim(F.when(html.contains("<h1"), h1).otherwise(F.regexp_extract(html, r"<title>([^<]*+)</title>", 1)), F.lit(SPACES))


#: Redaction rules, in the order in which they apply.
SECRET_RULES = (
    ("private_key", r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----"),
    ("aws_access_key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("github_token", r"\bgh[pousr]_[A-Za-z0-9]{36,}\b"),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    ("hex_secret", r"\b[0-9a-f]{40}\b"),
)


def redact_secrets(text: Column | str) -> Column:
    out = _as(text)
    for rule, pattern in SECRET_RULES:
        out = F.regexp_replace(out, pattern, f"[REDACTED:{rule}]")
    return out


def human_size(n: Column | str) -> Column:
    """Bytes as B, KB, MB or GB with one place, ties to even as the printed double rounds."""
    n = _as(n)
    shown = lambda unit, mark: F.concat(F.format_string("%.1f", F.bround(n / float(unit), 1)), F.lit(mark))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, shown(1 << 10, " KB")).when(n < 1 << 30, shown(1 << 20, " MB")).otherwise(shown(1 << 30, " GB"))


def column_letter(n: Column | str) -> Column:
    """A, B, ..., Z, AA, ... for 0, 1, ...; up to three letters."""
    n = _as(n)
    one = lambda x: F.chr(F.lit(65) + x % 26)
    two = lambda x: F.concat(one(F.floor(x / 26) - 1), one(x))
    return F.when(n < 26, one(n)).when(n < 702, two(n)).otherwise(F.concat(two(F.floor(n / 26) - 1), one(n)))


def time_of(seconds: Column | str) -> Column:
    s = F.floor(_as(seconds))
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)
