"""Keyed permutations within a format: a Feistel network over the words of an alphabet, over choices, and over the days of a range."""

from __future__ import annotations

import datetime as dt
import hashlib
import hmac
from collections.abc import Callable, Sequence

ROUNDS = 10
DIGITS = "0123456789"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _half(key: bytes, k: int, n: int, value: int, mod: int) -> int:
    mac = hmac.digest(key, b"%d|%d|%d" % (k, n, value), hashlib.sha256)
    return int.from_bytes(mac[:16], "big") % mod


def _number(word: str, alphabet: str) -> int:
    if alphabet == DIGITS:
        return int(word)
    out = 0
    for c in word:
        out = out * len(alphabet) + alphabet.index(c)
    return out


def _word(number: int, size: int, alphabet: str) -> str:
    if alphabet == DIGITS:
        return f"{number:0{size}d}"
    out = ""
    for _ in range(size):
        number, at = divmod(number, len(alphabet))
        out = alphabet[at] + out
    return out


def permute_word(word: str, alphabet: str, key: bytes, back: bool = False) -> str:
    """Another word of the same length over the alphabet; a bijection for each length and key. `back` inverts it.

    Words of one symbol are shifted by a keyed amount; the empty word stays.
    """
    n, radix = len(word), len(alphabet)
    if n == 0:
        return word
    if n == 1:
        shift = _half(key, 0, 1, 0, radix - 1) + 1 if radix > 1 else 0
        return alphabet[(alphabet.index(word) + (-shift if back else shift)) % radix]
    u = n // 2
    v = n - u
    a, b = _number(word[:u], alphabet), _number(word[u:], alphabet)
    # a lives modulo radix^u and b modulo radix^v; rounds change a and b in turn
    for k in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
        sign = -1 if back else 1
        if k % 2 == 0:
            a = (a + sign * _half(key, k, n, b, radix**u)) % radix**u
        else:
            b = (b + sign * _half(key, k, n, a, radix**v)) % radix**v
    return _word(a, u, alphabet) + _word(b, v, alphabet)


def permute_digits(digits: str, key: bytes, back: bool = False) -> str:
    return permute_word(digits, DIGITS, key, back)


def permute_valid(word: str, key: bytes, valid: Callable[[str], bool], back: bool = False, alphabet: str = DIGITS) -> str:
    """permute_word, walked along its cycle until `valid` holds again; a bijection on the valid words."""
    out = permute_word(word, alphabet, key, back)
    while not valid(out):
        out = permute_word(out, alphabet, key, back)
    return out


def permute_choice(value: str, choices: Sequence[str], key: bytes, back: bool = False) -> str:
    """Another of the choices; one that is none of them stays."""
    if value not in choices:
        return value
    width = len(str(len(choices) - 1))
    at = permute_valid(f"{choices.index(value):0{width}d}", key, lambda s: int(s) < len(choices), back)
    return choices[int(at)]


def permute_date(day: dt.date, key: bytes, first: dt.date = dt.date(1900, 1, 1), last: dt.date = dt.date(2099, 12, 31), back: bool = False) -> dt.date:
    """Another day of the range; days outside it stay. A bijection on the range."""
    if not first <= day <= last:
        return day
    span = (last - first).days + 1
    width = len(str(span - 1))
    at = permute_valid(f"{(day - first).days:0{width}d}", key, lambda s: int(s) < span, back)
    return first + dt.timedelta(days=int(at))
