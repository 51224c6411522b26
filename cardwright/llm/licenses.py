"""License scan: an Aho-Corasick automaton finds identifier tags and notice phrases; a shunting-yard parser reads expressions."""

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from .hashing import ALNUM_LOWER, utf8
from .shared import tidy

#: Phrases that count as base evidence, and their labels. Fixed values.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Further notice phrases and the labels they add.
NOTICES = {
    "gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl", "mozilla public license": "mpl",
    "eclipse public license": "epl", "bsd license": "bsd", "isc license": "isc", "boost software license": "bsl", "creative commons": "cc",
    "cc by nc": "cc-by-nc", "cc by sa": "cc-by-sa", "cc by nd": "cc-by-nd", "cc0": "cc0", "public domain": "public-domain",
    "permission is hereby granted free of charge": "mit", "redistribution and use in source and binary forms": "bsd",
    "licensed under the apache license": "apache", "all rights reserved": "all-rights-reserved", "proprietary and confidential": "proprietary",
}

#: The tag before an expression, in words.
TAG = "spdx license identifier"
_TAG = re.compile(rb"spdx-license-identifier[ \t]*:?[ \t]*([^\r\n]*)", re.IGNORECASE)
_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+-]*")

#: How binding the operators of an expression are: an exception belongs to its licence, then and, then or.
PRECEDENCE = {"with": 3, "and": 2, "or": 1}

#: Duties that come with a licence, by the first part of its identifier: 0 none to speak of, 1 notice, 2 share alike, 3 not open.
DUTIES = {"cc0": 0, "unlicense": 0, "0bsd": 0, "mit": 1, "apache": 1, "bsd": 1, "isc": 1, "bsl": 1, "cc": 1, "zlib": 1, "mpl": 2, "lgpl": 2, "epl": 2, "gpl": 2, "agpl": 2, "proprietary": 3}

#: Weights of the score: evidence of each kind is worth this much of what is still missing to 1.
TAG_WEIGHT, BASE_WEIGHT, NOTICE_WEIGHT = 0.9, 0.6, 0.3


def parse(expression: str) -> list[str] | None:
    """The expression's licences and operators in postfix order, or None if it is no expression.

    A licence or exception is one word; text after a complete expression (a comment's end, say) is not read.
    """
    out, held, operand = [], [], False
    for token in _TOKEN.findall(expression):
        word = token.lower()
        if word in PRECEDENCE:
            if not operand:
                return None
            while held and held[-1] != "(" and PRECEDENCE[held[-1]] >= PRECEDENCE[word]:
                out.append(held.pop())
            held.append(word)
            operand = False
        elif token == "(":
            if operand:
                break
            held.append(token)
        elif token == ")":
            if not operand or "(" not in held:
                break
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
        elif operand:
            break
        else:
            out.append(token)
            operand = True
    if not operand or "(" in held:
        return None
    return out + held[::-1]


def duty(name: str) -> int:
    parts = re.split(r"[-.+]", name.lower())
    return 3 if "nc" in parts or "nd" in parts else DUTIES.get(parts[0], 2)


def evaluate(postfix: list[str]) -> tuple[set[str], int]:
    """(licences named, duty): with or the licensee picks the lesser duty, and adds them up to the greater, with keeps that of its licence."""
    stack: list[tuple[set[str], int]] = []
    for token in postfix:
        if token in PRECEDENCE:
            (right, b), (left, a) = stack.pop(), stack.pop()
            stack.append((left, max(a - 1, 0)) if token == "with" else (left | right, min(a, b) if token == "or" else max(a, b)))
        else:
            stack.append(({token.lower()}, duty(token)))
    return stack[-1]


@cache
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, TAG}:
        found.add_word(f" {phrase} ", (len(phrase) + 2, phrase))
    found.make_automaton()
    return found


def scan_text(raw: bytes) -> dict:
    """What ``license_scan`` says of one text."""
    words = raw.translate(ALNUM_LOWER).split()
    plain = " " + b" ".join(words).decode("latin-1") + " "
    starts, base, labels, expressions, kinds, greatest = [], set(), set(), [], [0, 0, 0], -1
    at, spaces = 0, 0  # spaces counted so far: hits come in the order of their ends, so each stretch is counted once
    for end, (length, phrase) in automaton().iter(plain):
        if phrase in BASE:
            spaces, at = spaces + plain.count(" ", at, end), end
            starts.append(spaces - 1 - phrase.count(" "))
            base.add(BASE[phrase])
        if phrase in NOTICES:
            labels.add(NOTICES[phrase])
            kinds[2] += 1
        kinds[0] += phrase == TAG
    kinds[1] = len(starts)
    if kinds[0]:
        for m in _TAG.finditer(raw):
            said = m[1].decode("utf-8", "replace").strip()
            if (postfix := parse(said)) is not None:
                names, needs = evaluate(postfix)
                labels |= {f"spdx:{n}" for n in names}
                greatest = max(greatest, needs)
                expressions.append({"expression": said, "postfix": " ".join(postfix), "duty": needs})
    left = (1 - TAG_WEIGHT) ** min(len(expressions), 4) * (1 - BASE_WEIGHT) ** min(kinds[1], 16) * (1 - NOTICE_WEIGHT) ** min(kinds[2], 16)
    return {
        "n_words": len(words), "n_base": len(starts), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
        "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | labels)), "score": 1 - left, "expressions": expressions,
    }


_FIELDS = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "expressions": pa.list_(pa.struct([("expression", pa.string()), ("postfix", pa.string()), ("duty", pa.int32())]))}


def license_scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels, score and expressions.

    Words are runs of digits, letters and non-ASCII, A-Z folded. n_base counts all places, overlapping ones too, of the
    BASE phrases; first_word and last_word are the smallest and largest word numbers where one starts. labels adds those of
    NOTICES and ``spdx:`` and each licence of the expressions after an identifier tag. score is 1 minus a product over the
    evidence found, so 0 without any. Null and empty texts have no words, no labels ("") and score 0; each row is scanned by
    itself, so repeated rows agree. Columns of ``docs`` with the new names are replaced. No shuffle.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(text))
            rows = [scan_text(data[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            found = [pa.array([r[k] for r in rows], kind) for k, kind in _FIELDS.items()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], [*batch.schema.names, *_FIELDS])

    out = docs.drop(*_FIELDS)
    return out.mapInArrow(tidy(scan), T.StructType([*out.schema.fields, *from_arrow_schema(pa.schema(_FIELDS)).fields]))
