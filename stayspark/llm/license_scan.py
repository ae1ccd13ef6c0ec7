"""Licence scans: identifier tags and notice phrases, and the expressions
that they carry.

One Aho-Corasick automaton walks the words of a batch of texts (lower-cased,
one blank between words) and reports, in one pass and with overlaps, base
phrases, names of licences, notice cues (``licensed under``) and identifier
tags (``SPDX-License-Identifier:``). What follows a tag or a cue is read as
an expression of licences, ``and``, ``or``, ``with`` and parentheses: a
shunting-yard parser turns it into postfix order, which is evaluated to
labels and to a restriction from 0 to 1. ``or`` leaves the reader the less
restrictive side, ``and`` binds to the more restrictive one, an exception
(``with``) halves the restriction of its licence.

One pass over the texts without a shuffle; whole texts, in pieces of bounded
size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textbytes as B

PIECE_BYTES = 1 << 20

# Base phrases, names, cues, and how much each family restricts.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Names that are a notice wherever they stand.
FULL_NAMES = {
    "mit license": "mit", "apache license": "apache", "apache software license": "apache",
    "gnu general public license": "gpl", "gnu lesser general public license": "lgpl", "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl", "gnu free documentation license": "gfdl",
    "mozilla public license": "mpl", "eclipse public license": "epl", "common development and distribution license": "cddl",
    "european union public license": "eupl", "boost software license": "bsl", "artistic license": "artistic", "isc license": "isc",
    "zlib license": "zlib", "bsd 2 clause": "bsd-2-clause", "bsd 3 clause": "bsd-3-clause",
    "creative commons attribution": "cc-by", "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc", "creative commons attribution noncommercial sharealike": "cc-by-nc-sa",
    "creative commons attribution noderivatives": "cc-by-nd", "creative commons attribution noncommercial noderivatives": "cc-by-nc-nd",
    "creative commons zero": "cc0", "cc by sa": "cc-by-sa", "cc by nc": "cc-by-nc", "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd", "cc by nd": "cc-by-nd", "all rights reserved": "all-rights-reserved",
}
#: Names that count only after a cue.
SHORT_NAMES = {"mit": "mit", "apache": "apache", "gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "mpl": "mpl", "epl": "epl", "isc": "isc",
               "zlib": "zlib", "bsd": "bsd", "cc0": "cc0", "cc by": "cc-by", "unlicense": "unlicense",
               "classpath exception": "classpath-exception", "gcc runtime library exception": "gcc-exception",
               "linux syscall note": "linux-syscall-note", "llvm exception": "llvm-exception"}
CUES = ("licensed under", "licenced under", "released under", "distributed under", "available under", "published under",
        "under the terms of", "subject to", "license is", "licence is")
TAGS = ("spdx license identifier", "license identifier", "licence identifier")
FILLERS = frozenset("the a an terms of license licence licenses licences either both conditions at your option".split())
OPERATORS = {"or": 1, "and": 2, "with": 3}
#: By the longest prefix of the label; other licences count as DEFAULT.
RESTRICTION = {"unlicense": 0.1, "cc0": 0.1, "0bsd": 0.1, "wtfpl": 0.1, "mit": 0.2, "apache": 0.2, "bsd": 0.2, "isc": 0.2, "zlib": 0.2, "bsl": 0.2,
               "cc-by": 0.25, "artistic": 0.4, "mpl": 0.5, "lgpl": 0.5, "epl": 0.5, "cddl": 0.5, "eupl": 0.6, "cc-by-sa": 0.6, "gfdl": 0.7,
               "gpl": 0.7, "agpl": 0.8, "cc-by-nd": 0.9, "cc-by-nc": 0.9, "all-rights-reserved": 1.0}
DEFAULT = 0.5


# --- expressions ------------------------------------------------------------

def label_of(identifier: str) -> str:
    """``GPL-3.0-or-later`` -> ``gpl-3``, ``Apache-2.0`` -> ``apache-2``,
    ``CC-BY-NC-4.0`` -> ``cc-by-nc``."""
    x = re.sub(r"(-only|-or-later|\+)$", "", identifier.lower())
    x = re.sub(r"(?<=\d)(\.0)+$", "", x)
    return re.sub(r"-\d+(\.\d+)*$", "", x) if x.startswith("cc-") else x


def restriction_of(label: str) -> float:
    fits = [p for p in RESTRICTION if label == p or label.startswith(p + "-")]
    return RESTRICTION[max(fits, key=len)] if fits else DEFAULT


def postfix(tokens: Sequence[str]) -> list[str] | None:
    """Shunting yard: ``with`` binds before ``and``, ``and`` before ``or``,
    all from the left. None for what isn't an expression."""
    out, stack, operand = [], [], False
    for t in tokens:
        op = t.lower()
        if op in OPERATORS:
            if not operand:
                return None
            while stack and stack[-1] != "(" and OPERATORS[stack[-1]] >= OPERATORS[op]:
                out.append(stack.pop())
            stack.append(op)
            operand = False
        elif t == "(":
            if operand:
                return None
            stack.append(t)
        elif t == ")":
            if not operand:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        else:
            if operand:
                return None
            out.append(t)
            operand = True
    if not operand or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(rpn: Sequence[str]) -> tuple[float, tuple[str, ...]] | None:
    """(restriction, labels) of a postfix expression; None if an exception
    isn't a plain name or is set on more than one licence."""
    stack: list[tuple[float, tuple[str, ...]]] = []
    for t in rpn:
        if t not in OPERATORS:
            x = label_of(t)
            stack.append((restriction_of(x), (x,)))
            continue
        (rb, b), (ra, a) = stack.pop(), stack.pop()
        if t == "with":
            if len(a) > 1 or len(b) > 1 or " " in b[0]:
                return None
            stack.append((ra / 2, (f"{a[0]} with {b[0]}",)))
        else:
            stack.append(((min if t == "or" else max)(ra, rb), tuple(dict.fromkeys(a + b))))
    return stack[0]


_TOKEN = re.compile(r"[ \t]*([()]|[A-Za-z0-9][A-Za-z0-9.+-]*)")


def tag_expression(rest: str) -> list[str] | None:
    """Tokens of the expression after an identifier tag (``: MIT OR (A AND
    B)``), up to the end of what can be one; None without a colon."""
    m = re.match(r"[ \t]*:", rest)
    if not m:
        return None
    at, out, operand, depth = m.end(), [], False, 0
    while m := _TOKEN.match(rest, at):
        t = m.group(1)
        joins = t.lower() in OPERATORS or t == ")"
        if joins != operand or (t == ")" and not depth):
            break
        depth += (t == "(") - (t == ")")
        operand = t == ")" or not (joins or t == "(")
        out.append(t)
        at = m.end()
    while out and (out[-1].lower() in OPERATORS or out[-1] == "("):
        out.pop()
    return out or None


# --- scan -------------------------------------------------------------------

class Scanner:
    """The automaton, and what its matches mean."""

    def __init__(self, base: Mapping[str, str]):
        self.base = dict(base)
        self.auto = ahocorasick.Automaton()
        meanings: dict[str, list[tuple[str, str]]] = {}
        for phrase, label in self.base.items():
            meanings.setdefault(phrase, []).append(("base", label))
        for kind, names in (("full", FULL_NAMES), ("short", SHORT_NAMES)):
            for phrase, label in names.items():
                for spelt in {phrase, phrase.replace("license", "licence")}:
                    meanings.setdefault(spelt, []).append((kind, label))
        for kind, phrases in (("cue", CUES), ("tag", TAGS)):
            for phrase in phrases:
                meanings.setdefault(phrase, []).append((kind, ""))
        for phrase, means in meanings.items():
            # letters are the bytes of the UTF-8 text
            self.auto.add_word(f" {phrase} ".encode().decode("latin-1"), (len(phrase.encode()) + 2, phrase.count(" ") + 1, means))
        self.auto.make_automaton()

    def versioned(self, family: str, words: Sequence[str], at: int) -> tuple[str, int]:
        """(label, next word): a version number after a family's name."""
        i = at
        if i < len(words) and words[i] in ("version", "v"):
            i += 1
        if i < len(words) and (m := re.fullmatch(r"v?(\d+)", words[i])) and len(m.group(1)) <= 2:
            number, i = m.group(1), i + 1
            if i < len(words) and re.fullmatch(r"\d", words[i]):
                number, i = f"{number}.{words[i]}", i + 1
            return label_of(f"{family}-{number}"), i
        return family, at

    def notice(self, words: Sequence[str], names: Mapping[int, tuple[int, str]], at: int) -> tuple[list[str], int]:
        """Tokens of the expression that starts at a word, and the word that
        ends it."""
        out: list[str] = []
        operand = False
        while at < len(words):
            if at in names:
                n, family = names[at]
                if operand:
                    break
                label, at = self.versioned(family, words, at + n)
                out.append(label)
                operand = True
            elif operand and words[at: at + 2] == ["or", "later"]:
                at += 2
            elif operand and words[at: at + 3] == ["or", "any", "later"]:
                at += 3
            elif words[at] in OPERATORS and operand:
                out.append(words[at])
                operand = False
                at += 1
            elif words[at] in FILLERS:
                at += 1
            else:
                break
        while out and out[-1] in OPERATORS:
            out.pop()
        return out, at

    def document(self, words: Sequence[str], found: Sequence[tuple[int, int, list]], rest_of) -> dict:
        """One document's result from its matches (first word, words,
        meanings); ``rest_of(word)`` is the raw text after a word."""
        starts = [i for i, _, means in found for kind, _ in means if kind == "base"]
        base = sorted({x for _, _, means in found for kind, x in means if kind == "base"})
        full: dict[int, tuple[int, str]] = {}
        names: dict[int, tuple[int, str]] = {}
        for i, n, means in found:
            for kind, x in means:
                if kind in ("full", "short") and n > names.get(i, (0, ""))[0]:
                    names[i] = (n, x)
                if kind == "full" and n > full.get(i, (0, ""))[0]:
                    full[i] = (n, x)
        notices: list[tuple[int, list[str]]] = []
        read_to = 0  # names inside an expression aren't notices of their own
        for i, n, means in found:
            kinds = {kind for kind, _ in means}
            if "tag" in kinds and i + n > read_to:
                notices.append((i, tag_expression(rest_of(i + n - 1)) or []))
                read_to = i + n
            if "cue" in kinds:
                tokens, end = self.notice(words, names, i + n)
                notices.append((i, tokens))
                read_to = max(read_to, end if tokens else 0)
            if i in full and n == full[i][0] and i >= read_to:
                notices.append((i, [self.versioned(full[i][1], words, i + n)[0]]))
        labels, score, out = set(base), max(map(restriction_of, base), default=0.0), []
        for i, tokens in sorted(notices):
            rpn = postfix(tokens) if tokens else None
            value = evaluate(rpn) if rpn else None
            if value:
                labels.update(value[1])
                score = max(score, value[0])
                out.append({"start": i, "expression": " ".join(tokens), "restriction": value[0]})
        return {"n_base": len(starts), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
                "base_labels": base, "labels": sorted(labels), "score": score, "notices": out}


def _joined(data: np.ndarray, starts: np.ndarray):
    """The words of all rows as one string of bytes (a blank before each word,
    a blank and a line feed after each row), the place of each word's blank,
    the words' raw ends, and the rows' bounds in the words."""
    inside = B.WORD[data]
    s, e, row = B.runs(inside, starts)
    n = e - s
    word = np.repeat(np.arange(len(s)), n)
    bounds = np.searchsorted(row, np.arange(len(starts)))
    out = np.full(int(n.sum()) + len(s) + 2 * (len(starts) - 1), 32, np.uint8)
    shift = np.arange(len(s)) + 2 * row
    out[np.arange(len(word)) + (shift + 1)[word]] = B.LOWER[data[inside]]
    blanks = np.cumsum(n) - n + shift
    total = np.concatenate([[0], np.cumsum(n)])[bounds[1:]]
    out[total + bounds[1:] + 2 * np.arange(1, len(starts)) - 1] = 10
    return out.tobytes().decode("latin-1"), blanks, e, bounds


_NO_MATCH = {"n_base": 0, "first_word": None, "last_word": None, "base_labels": [], "labels": [], "score": 0.0, "notices": []}
_FOUND = ("n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double, "
          "notices array<struct<start:long,expression:string,restriction:double>>")
_ARROW = pa.struct([("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.list_(pa.string())),
                    ("labels", pa.list_(pa.string())), ("score", pa.float64()),
                    ("notices", pa.list_(pa.struct([("start", pa.int64()), ("expression", pa.string()), ("restriction", pa.float64())])))])


def _scan_batches(base: Mapping[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base)
        for b in batches:
            for lo, hi, data, starts in B.pieces(b.column(1), PIECE_BYTES):
                text, blanks, ends, bounds = _joined(data, starts)
                matches = [(last - size + 1, n, means) for last, (size, n, means) in scanner.auto.iter(text)]
                first = np.searchsorted(blanks, np.array([m[0] for m in matches], np.int64))
                row = np.searchsorted(bounds, first, side="right") - 1
                of: dict[int, list] = {}
                for m, w, r in zip(matches, first.tolist(), row.tolist()):
                    of.setdefault(r, []).append((w - int(bounds[r]), m[1], m[2]))
                got = [_NO_MATCH] * (hi - lo)
                for r, found in of.items():
                    a, z = int(bounds[r]), int(bounds[r + 1])
                    stop = int(blanks[z]) if z < len(blanks) else len(text)
                    words = text[int(blanks[a]) + 1: stop].split(" \n")[0].split(" ")
                    row_end = int(starts[r + 1])

                    def rest_of(w: int, a=a, row_end=row_end) -> str:
                        at = int(ends[a + w])
                        line = data[at: row_end].tobytes() if row_end - at < 4096 else _line(data, at, row_end)
                        return line.decode("latin-1")
                    got[r] = scanner.document(words, sorted(found, key=lambda m: m[:2]), rest_of)
                cols = pa.array(got, _ARROW)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(np.diff(bounds)), *cols.flatten()],
                                                 ["id", "n_words", *[f.name for f in _ARROW]])
    return run


def _line(data: np.ndarray, at: int, end: int) -> bytes:
    """The bytes from ``at`` to the end of their line."""
    step = at
    while step < end:
        brk = np.flatnonzero(data[step: step + 4096] == 10)
        if len(brk):
            return data[at: min(end, step + int(brk[0]))].tobytes()
        step += 4096
    return data[at: end].tobytes()


def scan(docs: DataFrame, base: Mapping[str, str] = BASE_PHRASES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_words, n_base, first_word, last_word, base_labels, labels,
    score, notices)``, one row per row of ``docs``.

    Words are runs of digits, letters and non-ASCII characters, A-Z
    lower-cased, numbered from 0. ``n_base`` counts the places where a phrase
    of ``base`` stands word by word (places may overlap), ``first_word`` and
    ``last_word`` are the least and greatest start (null without one).
    ``labels`` are those of the base phrases and of every expression found
    (``notices``: first word of the tag, cue or name; tokens; restriction);
    ``score`` is the greatest restriction, 0 without a notice. Lists are
    sorted. What isn't an expression after a tag or cue adds nothing.

    Null and empty texts have no words; repeated rows get a row each; null
    ids stay null; other columns are ignored; an empty table gives an empty
    table.
    """
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = kept.schema["id"].dataType.simpleString()
    return kept.mapInArrow(B.lean(_scan_batches(dict(base))), f"id {id_type}, n_words long, {_FOUND}")
