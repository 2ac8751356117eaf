"""Secrets: base patterns against a plain scan, windowed entropy against the formula, masks."""

from __future__ import annotations

import hashlib
import math
import random
import re
import signal
from collections import Counter

from sowmill.llm.secrets import CLASSES, allowed, entropy_spans, find_secrets, redact_secrets, redacted, secret_digest, spans_of, window_entropies


def base_by_scan(text):
    assign = [("assign", m.start(), m.end()) for m in re.finditer(
        r"""((?i:password|passwd|secret|token|api_?key))["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    access = [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    hexes = [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    order = ["assign", "access", "hex"]
    return sorted(assign + access + hexes, key=lambda s: (s[1], order.index(s[0])))


def pieces(seed, n):
    draw = random.Random(seed)
    parts = ["token = ", "PassWord:", '"secret" : \'', "api_key=", "apikey =", "AKIA", "IOSFODNN7EXAMPLE9", "ABCDEFGH12345678", "deadbeef", "0123456789abcdef", " ", "\n", "é", "xyz_-./=+", "AKIA"]
    return ["".join(draw.choice(parts) for _ in range(draw.randint(0, 14))) for _ in range(n)]


def test_base_spans_against_scan():
    for text in pieces(1, 3000):
        assert [s for s in spans_of(text) if s[0] != "entropy"] == base_by_scan(text)


def test_incremental_entropy_is_the_formula():
    draw = random.Random(2)
    for width in (3, 8, 24):
        text = "".join(draw.choice("aab01") for _ in range(100))
        for i, bits in enumerate(window_entropies(text, width)):
            counts = Counter(text[i:i + width]).values()
            assert abs(bits + sum(c / width * math.log2(c / width) for c in counts)) < 1e-9


def test_entropy_spans_against_every_window():
    draw = random.Random(3)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    for _ in range(200):
        text = " ".join("".join(draw.choice(alphabet[:draw.choice([4, 16, 64])]) for _ in range(draw.randint(10, 60))) for _ in range(3))
        at = draw.randint(0, len(text))
        text = text[:at] + draw.choice(["", "", "EXAMPLE", "example" * 3]) + text[at:]
        marked = set()
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
            if allowed(m[0]):
                continue
            for _, pattern, width, least in CLASSES:
                for run in pattern.finditer(m[0]):
                    if len(run[0]) < 20 or allowed(run[0]):
                        continue
                    own = min(width, len(run[0]))
                    for i in range(len(run[0]) - own + 1):
                        counts = Counter(run[0][i:i + own]).values()
                        if "example" in run[0][i:i + own].lower():
                            continue
                        if -sum(c / own * math.log2(c / own) for c in counts) >= least * math.log2(own) / math.log2(width) - 1e-9:
                            start = m.start() + run.start() + i
                            marked.update(range(start, start + own))
        assert {i for a, b in entropy_spans(text) for i in range(a, b)} == marked


def test_allow_list():
    for harmless in ["internationalizationandlocalization", "12345678901234567890123", "5f2b8a9c-1234-4abc-9def-0123456789ab", "path/to/some_file-name/2024",
                     "abcdefghijklmnopqrstuvwxyz0123456789"]:
        assert spans_of(harmless) == []
    assert [s[0] for s in spans_of("key ghp_16C7e42F292c6912E7710c838347Ae178B4a end")] == ["entropy"]


def test_allow_list_takes_what_one_pattern_takes():
    word = r"(?:[A-Za-z]?[a-z]*|[A-Z]+|[0-9]{1,8})"
    whole = re.compile(rf"[A-Za-z]+|[0-9]+|[-_=+/]+|{word}(?:[-_/+=]+{word})*")
    draw = random.Random(4)
    for _ in range(20000):
        text = "".join(draw.choice("aBc1-_/") for _ in range(draw.randint(0, 12))) + draw.choice(["", "_", "12345678", "123456789"])
        assert allowed(text) == bool(whole.fullmatch(text)) or text.lower() in "0123456789abcdefghijklmnopqrstuvwxyz0123456789"


def test_allow_list_is_linear():
    def stop(*_):
        raise TimeoutError

    before = signal.signal(signal.SIGALRM, stop)
    signal.alarm(10)
    try:
        for text in ["Signature" + "_" * 10000 + "12th", "-" * 10000 + "Page2b", "ab-" * 10000 + "12th", "A/" * 10000 + "12th"]:
            assert not allowed(text)
            spans_of(text)
    finally:
        signal.alarm(0)
        signal.signal(signal.SIGALRM, before)


def test_odd_rows(odd, nothing):
    out = secret_digest(find_secrets(odd)).collect()
    assert len(out) == odd.count()
    by_id = {r.doc_id: r for r in out}
    empty = hashlib.sha256(b"").hexdigest()
    for key in (1, 2, 3, None):
        assert (by_id[key].n_assign, by_id[key].n_access, by_id[key].n_hex, by_id[key].base_sha256, by_id[key].spans) == (0, 0, 0, empty, "")
    text = next(r.text for r in odd.collect() if r.doc_id == 8)
    (kind, start, end), = base_by_scan(text)
    assert by_id[8].spans == f"{kind}:{start}:{end}" and by_id[8].base_sha256 == hashlib.sha256(by_id[8].spans.encode()).hexdigest()
    assert find_secrets(nothing).count() == 0


def test_redaction_keeps_everything_else(odd):
    before = {(r.doc_id, r.text): r for r in odd.collect()}
    after = redact_secrets(odd)
    assert after.columns == odd.columns
    rows = after.collect()
    assert len(rows) == odd.count()
    masked = [r for r in rows if r.text and "[SECRET]" in r.text]
    assert [r.doc_id for r in masked] == [8] and masked[0].n_chars == len(masked[0].text)
    assert all((r.doc_id, r.text) in before for r in rows if r not in masked)
    assert redacted("token = abcdef token = abcdef", "#") == "# #"


def test_short_keys_and_the_sample_word():
    key = "aB3dE5gH7jK9mN1pQ4sT"
    assert len(key) == 20 and [s[0] for s in spans_of(f"use {key} here")] == ["entropy"]
    assert spans_of(f"use {key[:19]} here") == []
    assert spans_of("an ExampleKey20chars9Zx4 here") == []
    long = "aB3dE5gH7jK9mN1pQ4sT6vX8zL2c"
    (kind, start, end), = spans_of(f"{long}example")
    assert (kind, start, end) == ("entropy", 0, len(long) + len("exampl"))


def test_many_spans_take_linear_time():
    def stop(*_):
        raise TimeoutError

    draw = random.Random(5)
    words = ["".join(draw.choice("0123456789abcdef") for _ in range(32)) for _ in range(500)] + ["".join(draw.choice("abcdefghijkLMNOPQRS0123456789+/") for _ in range(28)) for _ in range(500)]
    text = " ".join(draw.choice(words) for _ in range(100_000))
    before = signal.signal(signal.SIGALRM, stop)
    signal.alarm(30)
    try:
        spans = spans_of(text)
        assert len(spans) > 85_000 and redacted(text, "#").count("#") > 85_000
    finally:
        signal.alarm(0)
        signal.signal(signal.SIGALRM, before)


def test_entropy_spans_within_any_base_span_are_left_out():
    draw = random.Random(6)
    for text in pieces(7, 1500):
        text += "".join(draw.choice("aB3dE5gH7jK9mN1pQ4sT6vX8zL2c/+=") for _ in range(draw.randint(0, 40)))
        base = base_by_scan(text)
        assert [s for s in spans_of(text) if s[0] == "entropy"] == [("entropy", a, b) for a, b in entropy_spans(text) if not any(s <= a and b <= e for _, s, e in base)]
