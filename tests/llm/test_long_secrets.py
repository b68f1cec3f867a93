"""Long keys of few symbols and key blocks of several lines."""

import random
import time

import pytest

from attribix.llm import secrets as S

HEX, BASE32 = "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE64 = BASE32 + "abcdefghijklmnopqrstuvwxyz0189+/"


def novel(text):
    return [text[s:e] for kind, s, e in S.spans_of(text) if kind == "novel"]


@pytest.mark.parametrize("length", [65, 96, 128, 256, 512, 2048])
@pytest.mark.parametrize("symbols", [HEX, BASE32, BASE64])
def test_long_keys(length, symbols):
    rng = random.Random(length)
    for _ in range(20):
        key = "A7" + "".join(rng.choices(symbols, k=length - 2))
        if S.HEX.search(key):
            continue  # a run of digits in it is a base span
        assert novel(f"the private key is {key} as given") == [key]


@pytest.mark.parametrize("length", [96, 128, 512])
def test_dashed_keys(length):
    rng = random.Random(length)
    for _ in range(20):
        key = "-".join("a7" + "".join(rng.choices(HEX.lower(), k=6)) for _ in range(length // 8))
        assert novel(f"signing key {key}") == [key]


def test_long_strings_that_repeat_are_no_keys():
    assert novel("session " + "connection2" * 30) == []
    assert novel("cookie " + "a" * 300 + "1") == []


@pytest.mark.parametrize("line_end", ["\n", "\r\n", "\\n"])
def test_key_blocks(line_end):
    rng = random.Random(3)
    body = ["".join(rng.choices(BASE64, k=n)) for n in (64, 64, 64, 64, 10)]
    text = line_end.join(["x", "-----BEGIN RSA PRIVATE KEY-----", *body, "-----END RSA PRIVATE KEY-----", "y"])
    assert novel(text) == body
    assert S.spans_of(S.mask(text)) == []
    assert not any(part in S.mask(text) for part in body)


def test_a_block_of_prose_is_no_key():
    assert novel("-----BEGIN PRIVATE KEY-----\nconfiguration directory environment\n-----END PRIVATE KEY-----") == []


def strings(symbols, n, count=20):
    rng = random.Random(n)
    return ["".join(rng.choices(symbols, k=n)) for _ in range(count)]


def test_letters_alone():
    letters = BASE64[:26] + BASE64[32:58]
    for length in (24, 40, 64):
        found = [novel(f"the private signing key is {key} as given") == [key] for key in strings(letters, length)]
        assert sum(found) >= 19
    for word in ("donaudampfschifffahrtsgesellschaft", "internationalisationinternational", "configurationenvironmentdirectory"):
        assert novel(f"the session {word} began") == []


def test_digits_are_hex_spans():
    for key in strings("0123456789", 30):
        assert S.spans_of(f"session auth {key}") == [("hex", 13, 43)]


def test_passwords_with_punctuation():
    rng = random.Random(6)
    for _ in range(20):
        key = "aA7!" + "".join(rng.choices("abcdefghXYZW0189!@#$%^&*?", k=14)) + "z"
        assert novel(f"my password is {key}!") == [key]
    assert novel("my password is ouvious###%%% and session Great!!!Again???Yes") == []


def test_the_line_after_a_colon():
    for key in strings(BASE64[:62], 64):
        if not S.HEX.search(key):
            assert novel(f"auth_value:\n  {key}\n") == [key]
            assert novel(f"auth_value = \r\n{key}\n") == [key]
            assert novel(f"auth_value.\n{key}\n") == []


@pytest.mark.parametrize("after", ["", "\n", "\nand prose goes on here", "\n\nnext"])
def test_a_block_without_an_end(after):
    body = strings(BASE64, 64, 5)
    head = "x\n-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\n\n"
    assert novel(head + "\n".join(body) + after) == body
    assert novel("-----BEGIN PRIVATE KEY-----\n" * 3 + "\n".join(body) + after) == body
    closed = "-----BEGIN PRIVATE KEY-----\n" + body[3] + "\n-----END PRIVATE KEY-----"
    assert novel(head + body[0] + "\n" + closed) == [body[0], body[3]]


@pytest.mark.parametrize("text", [
    "token " * 170_000, "token: " * 150_000, "token" * 40_000, "secret:\n" * 120_000, "auth " + "a1" * 60_000, "-----BEGIN PRIVATE KEY-----\n" * 30_000,
    "password=abcdefghijkl " * 40_000, "auth !" * 150_000, "session " + "aA1!" * 40_000,
])
def test_time_is_linear_in_a_line(text):
    begin = time.process_time()
    S.spans_of(text)
    assert time.process_time() - begin < 6
