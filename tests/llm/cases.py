"""Small tables the operator tests share: odd rows, and documents that repeat each other."""

from __future__ import annotations

import random

ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, words long, score double, block long, class long, kept string"


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty, blank and long texts, repeated rows, equal texts, and columns named like the operators' own."""
    long_text = " ".join(f"word{i % 977}" for i in range(30_000))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, "one", "en", "a", 3), (5, "the same short text of a few words", "en", "a", 34),
            (6, "the same short text of a few words", "en", "a", 34), (6, "the same short text of a few words", "en", "a", 34), (7, long_text, "en", "b", len(long_text)),
            (8, "naïve façade \U0001f600 token = \"abcDEF123456\" end", "fr", "b", 40), (None, "a row without an id of its own", None, "b", 30), (9, "12345 67890 !!!", None, None, 15),
            (10, "tab\tand  double  blanks <|endoftext|> and\r\nline ends", "en", "c", 50)]
    return [(*r, "x", 1, 0.5, 7, 7, "no") for r in rows]


def similar_texts(seed: int = 5, groups: int = 12) -> dict[int, str]:
    """Texts in groups of edited copies, with a passage that many share and passages repeated inside a text."""
    draw = random.Random(seed)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "ru", "ti") for b in ("ban", "der", "fol", "gis", "hum", "jat", "kel", "mor")]
    passage = " ".join(draw.choice(words) for _ in range(60))
    out: dict[int, str] = {}
    for _ in range(groups):
        base = [draw.choice(words) for _ in range(draw.randint(3, 160))]
        for _ in range(draw.randint(1, 7)):
            text = list(base)
            for _ in range(draw.choice([0, 0, 1, 2, 5, 12])):
                text[draw.randrange(len(text))] = draw.choice(words)
            body = " ".join(text)
            if draw.random() < 0.4:
                body = f"{body}\n{passage}" if draw.random() < 0.5 else f"{passage} {body}"
            if draw.random() < 0.2:
                body = f"{body} {body}"
            out[len(out) * 3 + 1] = body
    return out
