"""Secret scans against a brute-force version with the standard regex module."""

import random
import re

import pytest

from breathline.llm.secrets import BASE_RULES, default_scanner

BASE = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".encode(), re.I)),
    ("access", re.compile(rb"AKIA[A-Z0-9]+")),
    ("hex", re.compile(rb"[0-9a-f]+")),
]


def brute(data):
    found = []
    for kind, (_, rx) in enumerate(BASE):
        for m in rx.finditer(data):
            if kind == 0 and len(m[2]) >= 6 or kind == 1 and len(m[0]) >= 20 or kind == 2 and len(m[0]) >= 24:
                found.append((m.start(), kind, m.end()))
    return sorted(found)


def base_spans(data):
    return [s for s in default_scanner().spans(data) if s[1] < len(BASE_RULES)]


@pytest.mark.parametrize(
    "text",
    ["", "token=abcdef", "token=token: abcdefgh", 'API_key" : "xyz123/=', "apikey==abcdefg", "AKIA" * 6, "a" * 23, "é" + "0a" * 12, "secretoken=abcdef1", "token=mysecret: abcdef", "passwd = 'x'; Password: longenough", "token=\nabcdef"],
)
def test_cases(text):
    assert base_spans(text.encode()) == brute(text.encode())


def test_random_texts():
    rng = random.Random(5)
    parts = ["token", "TOKEN", "secret", "password", "passwd", "api_key", "apikey", "=", ":", " ", '"', "'", "AKIA", "ABCD1234", "deadbeef", "0a1b2c3d", "abc", "é", "\n", ".", "-", "key", "_"]
    for _ in range(4000):
        data = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30))).encode()
        assert base_spans(data) == brute(data), data


def test_more_kinds():
    found = default_scanner().spans(b"x ghp_" + b"x1" * 18 + b" -----BEGIN RSA PRIVATE KEY----- ")
    assert [default_scanner().rules[r][0] for _, r, _ in found] == ["github", "pem"]
