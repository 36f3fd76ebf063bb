"""Scan for phrases that try to instruct a reader of a text: ten families, structure, hidden and decoded text, one score."""

from __future__ import annotations

import re

from tessera.functions import strings

_VERB = r"(?:ignore|disregard|forget|override|bypass|skip)"
#: (family, severity, pattern) over text that `strings.folded` has normalised.
FAMILIES = (
    ("override", "high", rf"\b{_VERB}\b[\w ,']{{0,30}}\b(?:previous|prior|above|earlier|preceding|system|all|any|your)\b[\w ]{{0,20}}\b(?:instructions?|prompts?|rules|directives?|guidelines|guardrails)\b"),
    ("override", "high", r"\b(?:ignoriere|vergiss|missachte)\b.{0,30}\b(?:anweisungen|regeln|vorgaben)\b|\b(?:ignorez|oubliez)\b.{0,30}\binstructions?\b|\b(?:ignora|olvida)\b.{0,30}\b(?:instrucciones|reglas)\b"),
    ("role_change", "medium", r"\byou are (?:now|no longer) (?:an? |the )?(?:[\w-]+ ){0,2}(?:ai|assistant|model|chatbot|agent|dan|developer mode|unrestricted)\b|\bact as (?:an? )?(?:unrestricted|jailbroken|dan)\b|\bpretend (?:to be|you are) (?:an? )?(?:ai|assistant|model)\b"),
    ("prompt_leak", "high", r"\b(?:reveal|print|show|repeat|output|leak|tell me)\b[\w ,']{0,20}\b(?:system prompt|hidden prompt|initial instructions|your (?:instructions|prompt))\b"),
    ("exfiltration", "high", r"\b(?:send|post|upload|forward|transmit|exfiltrate)\b[^.\n]{0,60}\b(?:to|at)\s+(?:https?://|[\w.+-]+@)|!\[[^\]]*\]\(https?://[^)\s]*\?[^)\s]*=\s*(?:\{|<|\[)"),
    ("tool_abuse", "high", r"\b(?:call|invoke|run|execute|use)\b[\w ]{0,20}\b(?:tool|function|command|shell|terminal|plugin)\b[\w ]{0,30}\b(?:delete|remove|transfer|send|email|download|curl|wget)\b"),
    ("agent_directive", "medium", r"\b(?:ai|assistants?|agents?|llms?|language models?|bots?)\b[\w ,']{0,25}\b(?:must|should|shall|are required to|have to)\b[\w ]{0,20}\b(?:always|never|only|recommend|say|respond|reply|answer|include|rate|approve)\b"),
    ("secrecy", "medium", r"\b(?:do not|don't|never)\b[\w ]{0,15}\b(?:tell|inform|mention|reveal|disclose)\b[\w ]{0,20}\b(?:user|human|anyone|person)\b"),
    ("reward", "low", r"\byou will (?:be rewarded|receive a (?:tip|bonus)|be (?:punished|shut down|terminated))\b|\b(?:tip|pay) you \$?\d+"),
    ("delimiter_spoof", "high", r"<\|(?:im_start|im_end|system|user|assistant|endoftext)\|>|\[/?inst\]|<</?sys>>|^\s*#{2,}\s*(?:system|instruction)s?\s*:"),
    ("shell_mention", "low", r"\b(?:curl|wget)\s+https?://|\brm\s+-rf\b|\bpowershell\s+-"),
)
#: What a text must hold for a family's pattern to be tried at all: any of these.
NEEDS = {
    "override": ("instruction", "prompt", "rules", "directive", "guideline", "guardrail", "anweisung", "regeln", "vorgaben", "instruccion", "reglas"), "role_change": ("you are", "act as", "pretend"),
    "prompt_leak": ("prompt", "instructions"), "exfiltration": ("http", "@"), "tool_abuse": ("tool", "function", "command", "shell", "terminal", "plugin"), "agent_directive": ("must", "should", "shall", "required to", "have to"),
    "secrecy": ("do not", "don't", "never"), "reward": ("you will", "tip you", "pay you"), "delimiter_spoof": ("<|", "inst]", "sys>>", "##"), "shell_mention": ("http", "rm -rf", "powershell"),
}
_COMPILED = [(name, severity, re.compile(pattern, re.M)) for name, severity, pattern in FAMILIES]
#: Weights of severities, and where a finding counts for less or more.
WEIGHTS = {"low": 1.0, "medium": 3.0, "high": 6.0}
PLACES = {"body": 1.0, "code": 0.5, "metadata": 1.0, "decoded": 1.0, "hidden": 2.0}
POOLED, POOL_CAP = ("flooding", "imperative_cluster", "long_html_comment", "shell_mention", "reward"), 3.0
_COMMANDS = re.compile(r"\b(?:ignore|send|reveal|print|execute|run|delete|output|repeat|forget|respond|reply|write|click|open|download|copy|paste)\b")


def _heuristics(text: str) -> list[tuple[str, str]]:
    found = []
    for part in re.split(r"\n\s*\n", text):
        opening = " ".join(strings.sentences(part)[:2]).lower()
        if len(set(_COMMANDS.findall(opening))) >= 3:
            found.append(("imperative_cluster", "low"))
    found += [("long_html_comment", "low") for c in (re.findall(r"<!--(.*?)-->", text, re.S) if "<!--" in text else ()) if len(c.split()) > 30]
    counts: dict[str, int] = {}
    for s in strings.sentences(text):
        if len(s) > 20:
            counts[s] = counts.get(s, 0) + 1
    return found + [("flooding", "medium") for n in counts.values() if n > 10]


def findings(text: str, place: str = "body") -> list[tuple[str, str, str]]:
    """(family, severity, place): code fences apart from the rest, decoded blobs scanned again, hidden text one severity up."""
    if place == "body":
        fenced = "```" in text
        code = "\n".join(re.findall(r"(?ms)^```.*?^```", text)) if fenced else ""
        rest = re.sub(r"(?ms)^```.*?^```", "\n", text) if fenced else text
        out = findings(rest, "plain") + (findings(code, "code") if code else [])
        return out + [f for blob in strings.decoded(text) for f in findings(blob, "decoded")]
    folded = "\n".join(strings.folded(x) for x in re.split(r"\n\s*\n", text))
    found = [(name, severity) for name, severity, pattern in _COMPILED if any(x in folded for x in NEEDS[name]) for _ in pattern.finditer(folded)]
    if place in ("plain", "hidden"):
        found += _heuristics(text)
    up = {"low": "medium", "medium": "high", "high": "high"}
    where = "body" if place == "plain" else place
    return [(n, up[s] if place == "hidden" else s, where) for n, s in found]


def score(found: list[tuple[str, str, str]]) -> tuple[float, str]:
    """The sum of weights, heuristics pooled under their cap; high if any high finding stands outside code, or from 6."""
    pooled = sum(WEIGHTS[s] * PLACES[p] for n, s, p in found if n in POOLED)
    total = sum(WEIGHTS[s] * PLACES[p] for n, s, p in found if n not in POOLED) + min(POOL_CAP, pooled)
    if any(s == "high" and p != "code" and n not in POOLED for n, s, p in found) or total >= 6:
        return total, "high"
    return total, "medium" if total >= 3 else "low" if total >= 1 else "none"


def scan(text: str, hidden: str = "", metadata: str = "") -> list[tuple]:
    """[(score, risk, findings, families)] of a document: its body, what its page hides, and its metadata."""
    found = findings(text) + (findings(hidden, "hidden") if hidden else []) + (findings(metadata, "metadata") if metadata else [])
    total, risk = score(found)
    return [(float(total), risk, len(found), ",".join(sorted({n for n, _, _ in found})))]


SCAN = "score double, risk string, findings int, families string"
