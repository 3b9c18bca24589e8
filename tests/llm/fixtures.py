"""Small tables with every case that the operators define a result for."""

from __future__ import annotations

import random
import re

WORDS = (
    "the and of to in is that with for by this are has was but cc license general public all rights "
    "reserved Émile señor straße über tree river stone cloud seven eight nine copper silver paper"
).split()

#: Columns whose names clash with those that operators use inside or return.
CLASH = (
    "score", "predicted", "key", "node", "component_id", "size", "taken", "features", "n_words",
    "kept", "start", "stop", "doc", "_doc", "_draw", "_good", "_text", "n_lines", "target", "text_",
)


def sentence(r: random.Random, n: int) -> str:
    return " ".join(r.choice(WORDS) + str(r.randrange(300)) for _ in range(n))


def documents() -> list[tuple]:
    """``doc_id, text, lang, source, n_chars`` with copies, edits, junk and odd rows."""
    r = random.Random(5)
    texts: list[str | None] = []
    passage = "\n".join(sentence(r, 14) for _ in range(7))
    for i in range(24):
        texts.append("\n".join(sentence(r, r.randrange(3, 30)) for _ in range(r.randrange(1, 9))))
    for i in range(6):  # a passage that several texts share
        texts.append(f"{sentence(r, 9)}\n{passage}\n{sentence(r, 20 + i)}")
    base = "\n".join(sentence(r, 40) for _ in range(6))
    for i in range(10):  # near copies of one text, the first ones exact
        words = base.split(" ")
        for k in range(i // 2):
            words[(i * 37 + k * 53) % len(words)] = f"changed{i}x{k}"
        texts.append(" ".join(words))
    texts += [
        None, "", "   \n\t ", "one", "two words", "That it.", "That it.",
        "CC BY cc-by, CC by! All rights reserved? ALL RIGHTS RESERVED general public license",
        "Licensed under the Apache License, Version 2.0.", "KK cc byé cc bİy",
        "a " * 900, "x" * 3000, "ab" * 700, "é€\U0001f600 " * 300,
        sentence(r, 2500),  # very long for this table
        "spam!! ### $$$ " * 40, "- - - | | |", "tab\tand\x0bvertical\x0cfeed\rreturn",
        "\x1cunit\x1fseparators stay",
    ]
    rows = [(i, t, "en", f"src{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    rows.append(rows[3])  # a row that repeats
    rows.append((None, texts[4], "en", None, 3))
    rows.append((None, None, None, None, None))
    rows.append((900, texts[5], None, None, None))
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def low(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
