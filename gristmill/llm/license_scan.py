"""License scans (operator 7).

An Aho-Corasick automaton runs once over a text's words and finds notice phrases and the tag that stands before a
licence expression. An expression is read by a shunting-yard parser: WITH binds before AND, AND before OR. Each
licence has a permissiveness; AND takes the least, OR the greatest, and an exception raises what it is added to.
The expression ends at the first token that can't continue it, so prose and comment ends after it are no licences.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame

from gristmill.llm.rows import id_back, keyed, map_rows

# The base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Further notices and their labels.
NOTICES = {
    "gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl", "mozilla public license": "mpl",
    "bsd license": "bsd", "redistribution and use in source and binary forms": "bsd", "isc license": "isc",
    "permission is hereby granted free of charge": "mit", "eclipse public license": "epl", "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa", "cc by nd": "cc-by-nd", "creative commons attribution": "cc-by", "cc0": "cc0", "public domain": "public-domain",
    "all rights reserved": "proprietary",
}
TAG = "spdx license identifier"
#: Permissiveness by label; an unknown licence has that of no notice.
LEAVES = {
    "mit": 1.0, "apache": 1.0, "bsd": 1.0, "isc": 1.0, "cc0": 1.0, "public-domain": 1.0, "cc-by": 0.9, "cc-by-sa": 0.6, "mpl": 0.6, "epl": 0.6,
    "lgpl": 0.5, "cc-by-nd": 0.3, "cc-by-nc": 0.3, "gpl": 0.3, "agpl": 0.2, "proprietary": 0.0,
}
UNKNOWN, EXCEPTION = 0.0, 0.2
# Further licence identifiers; a family above also stands alone or with a version.
IDENTIFIERS = {
    "0bsd", "artistic-2.0", "bsl-1.0", "cddl-1.0", "eupl-1.2", "ms-pl", "ncsa", "odbl-1.0", "ofl-1.1", "openssl", "postgresql", "python-2.0",
    "unlicense", "wtfpl", "x11", "zlib",
}
OWN = "licenseref-"
_ORDER = {"or": 1, "and": 2, "with": 3}
_TAG = re.compile(r"spdx-license-identifier:[ \t]*([^\n]*)")
_TOKEN = re.compile(r"[a-z0-9.+:-]+|[()]")
_NEXT = re.compile(r"[ \t]*([()]|[a-z0-9][a-z0-9.+-]*)")
#: Bytes of words are kept, A-Z lowered; all others become blanks.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """Phrases between blanks, so that only whole words match."""
    found = ahocorasick.Automaton()
    for phrase in [*BASE, *NOTICES, TAG]:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def family(identifier: str) -> str:
    """Label of a licence identifier: its known family, or the identifier itself."""
    name = identifier.rstrip("+")
    for known in sorted(LEAVES, key=len, reverse=True):
        if name == known or name.startswith(known + "-"):
            return known
    return name


def known(identifier: str) -> bool:
    """Whether it names a licence: a family, with or without a version, one of the list, or a reference of the text's own."""
    name = identifier.rstrip("+")
    label = family(name)
    return name in IDENTIFIERS or (name.startswith(OWN) and name != OWN) or label in LEAVES and (name == label or name[len(label) + 1:][:1].isdigit())


def expression(line: str) -> list[str]:
    """The tokens after a tag that make an expression: up to the first that can't continue it, such as a word of prose, two
    licences side by side, the end of a comment, or a full stop. NONE and NOASSERTION name no licence."""
    out: list[str] = []
    at = depth = 0
    operand = False
    while found := _NEXT.match(line, at):
        token, at = found[1].rstrip("."), found.end()
        if token == "(" and not operand:
            depth += 1
        elif token == ")" and operand and depth:
            depth -= 1
        elif operand and token in ("and", "or") or token == "with" and out and out[-1] not in _ORDER and out[-1] not in "()":
            operand = False
        elif not operand and token and token not in _ORDER and token not in "()" and (known(token) or out[-1:] == ["with"]):
            operand = True
        else:
            break
        out.append(token)
        if token != found[1]:
            break
    while out and (out[-1] in _ORDER or out[-1] == "("):
        out.pop()
    return out


def postfix(tokens: list[str]) -> list[str]:
    """Shunting-yard. Operators without an operand and stray brackets are dropped, so any line has a reading; two
    licences side by side are read as AND."""
    out: list[str] = []
    stack: list[str] = []
    operand = False
    for token in tokens:
        if token in _ORDER:
            if not operand:
                continue
            while stack and stack[-1] != "(" and _ORDER[stack[-1]] >= _ORDER[token]:
                out.append(stack.pop())
            stack.append(token)
            operand = False
        elif token == ")":
            if "(" not in stack:
                continue
            if not operand and stack[-1] in _ORDER:
                stack.pop()
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        else:
            if operand:
                while stack and stack[-1] != "(" and _ORDER[stack[-1]] >= _ORDER["and"]:
                    out.append(stack.pop())
                stack.append("and")
            if token == "(":
                stack.append(token)
                operand = False
            else:
                out.append(token)
                operand = True
    if not operand:
        while stack and stack[-1] == "(":
            stack.pop()
        if stack:
            stack.pop()
    return out + [t for t in reversed(stack) if t != "("]


def evaluate(tokens: list[str]) -> tuple[set[str], float]:
    """Labels and permissiveness of an expression's tokens."""
    stack: list[tuple[set[str], float]] = []
    for token in postfix(tokens):
        if token not in _ORDER:
            label = family(token)
            stack.append(({label}, LEAVES.get(label, UNKNOWN)))
        elif len(stack) >= 2:
            (b, y), (a, x) = stack.pop(), stack.pop()
            # An exception is no licence: its name is no label.
            stack.append((a, min(1.0, x + EXCEPTION)) if token == "with" else (a | b, min(x, y) if token == "and" else max(x, y)))
    labels, least = set(), 1.0
    for a, x in stack:
        labels, least = labels | a, min(least, x)
    return (labels, least) if stack else (set(), UNKNOWN)


def scan(text: str) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score) of a text."""
    raw = text.encode()
    words = raw.translate(_WORD_BYTES).split()
    joined = " " + b" ".join(words).decode() + " "
    base: set[str] = set()
    labels: set[str] = set()
    starts: list[int] = []
    scores: list[float] = []
    tagged = False
    last_end, count = 0, 0
    for end, phrase in automaton().iter(joined):
        start = end - len(phrase) - 1  # of the blank before the phrase
        if phrase == TAG:
            tagged = True
            continue
        if phrase in BASE:
            count += joined.count(" ", last_end, start) if start >= last_end else -joined.count(" ", start, last_end)
            last_end = start
            starts.append(count)
            base.add(BASE[phrase])
        label = BASE.get(phrase) or NOTICES[phrase]
        labels.add(label)
        scores.append(LEAVES[label])
    if tagged:
        for line in _TAG.findall(raw.lower().decode()):
            found, value = evaluate(expression(line))
            if found:
                labels |= found
                scores.append(value)
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
            ",".join(sorted(labels)), min(scores, default=0.0))


def scan_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row per row with the words, the places of base phrases, all labels, and the permissiveness: the least of all
    notices and expressions, 0 without any. A null text is empty. The work is local to a row."""
    out = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
    return map_rows(keyed(docs, id_column, text_column), out,
                    lambda rows: ((i, *scan(text)) for i, _, text in rows)).withColumn("doc_id", id_back("doc_id"))
