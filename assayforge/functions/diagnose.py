"""What is wrong with a structure text, where, and which mechanical repair reads.

Character, bracket, parenthesis and ring checks look at the text alone and report
all they find; chemistry is checked once the text is sound.
"""

from __future__ import annotations

import re

from assayforge.functions import smiles

ORDER = ("empty", "characters", "brackets", "parentheses", "rings", "syntax", "aromaticity", "valence")


def caret(text: str, at: int | None) -> str:
    """A line that marks a place."""
    return "" if at is None else " " * min(at, len(text)) + "^"


def tokens(text: str) -> list[tuple[str, str, int]]:
    """(kind, text, offset) of each token; unreadable characters are kind "bad"."""
    return [(m.lastgroup, m.group(), m.start()) for m in smiles.TOKEN.finditer(text)]


def lexical(text: str) -> list[tuple[str, str, int]]:
    """Problems (category, message, offset) that the text alone shows."""
    found, depth, open_, last, atoms = [], [], {}, None, 0
    back: list = []
    for kind, t, at in tokens(text):
        if kind == "bad":
            if t.isspace():
                found.append(("characters", "white space", at))
            elif ord(t) > 127:
                found.append(("characters", f"character {t!r} is not ASCII", at))
            elif t in "[]":
                found.append(("brackets", f"unmatched {t}", at))
            else:
                found.append(("characters", f"unexpected character {t!r}", at))
        elif kind in ("bracket", "atom"):
            if kind == "bracket":
                try:
                    smiles.bracket_atom(t, at)
                except smiles.Problem as e:
                    found.append(("brackets", e.message, at))
            last, atoms = atoms, atoms + 1
        elif kind == "open":
            depth.append(at)
            back.append(last)
        elif kind == "close":
            if depth:
                depth.pop()
                last = back.pop()
            else:
                found.append(("parentheses", "unmatched )", at))
        elif kind == "ring":
            n = int(t.lstrip("%"))
            if last is None:
                found.append(("rings", "ring number before any atom", at))
            elif n in open_:
                if open_.pop(n)[0] == last:
                    found.append(("rings", f"ring {n} closes on its own atom", at))
            else:
                open_[n] = (last, at)
        elif kind == "dot":
            last = None
    found += [("parentheses", "unmatched (", at) for at in depth]
    found += [("rings", f"ring {n} is never closed", at) for n, (_, at) in open_.items()]
    return sorted(found, key=lambda p: (ORDER.index(p[0]), p[2]))


def repairs(text: str, allowed: tuple[str, ...] = ORDER) -> list[tuple[str, str]]:
    """(what was done, text) of each mechanical repair that makes the structure read."""
    out: list[tuple[str, str]] = []

    def offer(kind: str, name: str, candidate: str) -> None:
        if kind in allowed and candidate != text and candidate not in (c for _, c in out) and smiles.parse(candidate) is not None:
            out.append((name, candidate))

    plain = re.sub("[‐-―−]", "-", text)
    plain = re.sub(r"\s+", "", plain)
    offer("characters", "plain dashes, no white space", plain)
    first = text.split()[0] if text.split() else ""
    offer("characters", "first token only", first)
    missing = sum(1 for c, _, _ in lexical(plain) if c == "parentheses")
    if missing:
        offer("parentheses", "closing ) added", plain + ")" * max(0, plain.count("(") - plain.count(")")))
        depth, kept = 0, []
        for ch in plain:
            depth += (ch == "(") - (ch == ")")
            if depth < 0:
                depth = 0
                continue
            kept.append(ch)
        offer("parentheses", "unmatched ) dropped", "".join(kept) + ")" * depth)
    for category, _, at in lexical(plain):
        if category == "rings":
            size = 3 if plain[at] == "%" else 1
            offer("rings", "ring number dropped", plain[:at] + plain[at + size :])
    offer("brackets", "closing ] added", plain + "]")
    for m in re.finditer("n", plain):
        offer("aromaticity", "hydrogen on aromatic nitrogen", plain[: m.start()] + "[nH]" + plain[m.end() :])
    offer("aromaticity", "aromatic letters in upper case", re.sub(r"(?<!\[)[bcnops](?!l|r)", lambda m: m.group().upper(), plain))
    return out


def diagnose(text: str | None, try_repair: bool = True) -> dict:
    """status (ok, empty, invalid), problems in order of category and place, candidate repairs."""
    if text is None or not text.strip() or text.strip().lower() == "nan":
        return {"status": "empty", "problems": [("empty", "no structure", None)], "repairs": []}
    found: list = lexical(text.strip())
    if not found:
        try:
            smiles.checked(text)
        except smiles.Problem as e:
            found = [(e.category, e.message, e.at)]
    if not found:
        return {"status": "ok", "problems": [], "repairs": []}
    return {"status": "invalid", "problems": found, "repairs": repairs(text.strip()) if try_repair else []}
