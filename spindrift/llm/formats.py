"""Formats of numbers that name a person: how each is checked, and its keyed permutation within the format.

A number is taken as its letters and digits, without what separates them. Its parts are permuted one after the other,
each under a key that the parts before have a share in, so that equal parts of different numbers do not show; what is
computed from the others is computed anew. Every permutation is a bijection on the valid numbers of its format.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable

from spindrift.llm.feistel import DIGITS, LETTERS, permute_choice, permute_date, permute_digits, permute_valid, permute_word

# Fixed values of the formats: check letters by the number modulo 23; months of the tax code; values of its characters at odd places; suffixes; two-digit country codes.
_DNI = "TRWAGMYFPDXBNJZSQVHLCKE"
_CF_MONTHS = "ABCDEHLMPRST"
_CF_ODD = dict(zip(DIGITS + LETTERS, (1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23)))
_NINO_SUFFIX = "ABCD"
_NINO = re.compile(r"(?!BG|GB|KN|NK|NT|TN|ZZ)[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z]\Z")
_COUNTRY = re.compile(r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}")
_DEPARTMENTS = [f"{i:02d}" for i in range(1, 96) if i != 20] + ["2A", "2B"]


def core(value: str) -> str:
    """Letters and digits only, in upper case."""
    return "".join(c for c in value.upper() if c.isascii() and c.isalnum())


def digits(value: str) -> str:
    return "".join(c for c in value if c.isascii() and c.isdigit())


def laid_out(value: str, new: str) -> str:
    """The value with its letters and digits, of which `new` has as many, replaced."""
    left = iter(new)
    return "".join(next(left) if c.isascii() and c.isalnum() else c for c in value)


# -- checks ------------------------------------------------------------------------------------------------------------


def valid_ssn(s: str) -> bool:
    d = digits(s)
    return len(d) == 9 and d[:3] not in ("000", "666") and d[3:5] != "00" and d[5:] != "0000"


def dni_letter(number: str) -> str:
    return _DNI[int(number) % 23]


def nir_key(body: str) -> str:
    return f"{97 - int(body.replace('2A', '19', 1).replace('2B', '18', 1) if body[5:7] in ('2A', '2B') else body) % 97:02d}"


def cf_letter(body: str) -> str:
    even = {c: i for i, c in enumerate(DIGITS)} | {c: i for i, c in enumerate(LETTERS)}
    return LETTERS[sum(_CF_ODD[c] if i % 2 == 0 else even[c] for i, c in enumerate(body)) % 26]


def steuer_digit(body: str) -> str:
    p = 10
    for c in body:
        p = ((int(c) + p) % 10 or 10) * 2 % 11
    return str((11 - p) % 10)


def nif_digit(body: str) -> str:
    r = 11 - sum(int(c) * w for c, w in zip(body, range(9, 1, -1))) % 11
    return "0" if r > 9 else str(r)


def bsn_digit(body: str) -> str | None:
    r = sum(int(c) * w for c, w in zip(body, range(9, 1, -1))) % 11
    return None if r == 10 else str(r)


def cpf_digits(body: str) -> str:
    for _ in range(2):
        r = sum(int(c) * w for c, w in zip(body, range(len(body) + 1, 1, -1))) % 11
        body += "0" if r < 2 else str(11 - r)
    return body[9:]


def valid_iban(s: str) -> bool:
    c = core(s)
    return len(c) >= 15 and int("".join(str(int(x, 36)) for x in c[4:] + c[:4])) % 97 == 1


# -- permutations ------------------------------------------------------------------------------------------------------


def _ssn(c: str, key: bytes) -> str:
    return permute_valid(c, key, valid_ssn)


def _dni(c: str, key: bytes) -> str:
    d = permute_digits(c[:8], key)
    return d + dni_letter(d)


def _nie(c: str, key: bytes) -> str:
    first = permute_word(c[0], "XYZ", key)
    d = permute_digits(c[1:8], key + first.encode())
    return first + d + dni_letter(f"{'XYZ'.index(first)}{d}")


def _nino(c: str, key: bytes) -> str:
    number = permute_digits(c[2:8], key)
    key += number.encode()
    prefix = permute_valid(c[:2], key, lambda s: _NINO.match(s) is not None, alphabet=LETTERS) if _NINO.match(c[:2]) else permute_word(c[:2], LETTERS, key)
    return prefix + number + permute_word(c[8], _NINO_SUFFIX, key)


def _nir(c: str, key: bytes) -> str:
    place = permute_digits(c[7:10], key)
    order = permute_digits(c[10:13], key + place.encode())
    key += (place + order).encode()
    year = permute_digits(c[1:3], key)
    month = permute_choice(c[3:5], [f"{i:02d}" for i in range(1, 13)], key + year.encode())
    department = permute_choice(c[5:7], _DEPARTMENTS, key + year.encode())
    body = permute_word(c[0], "12", key) + year + month + department + place + order
    return body + nir_key(body)


def _cf(c: str, key: bytes) -> str:
    name = permute_word(c[:6], LETTERS, key)
    key += name.encode()
    year = permute_digits(c[6:8], key)
    month = permute_word(c[8], _CF_MONTHS, key + year.encode())
    day = permute_choice(c[9:11], [f"{i:02d}" for i in (*range(1, 32), *range(41, 72))], key + year.encode())
    town = permute_word(c[11], LETTERS, key + b"t") + permute_digits(c[12:15], key + day.encode())
    body = name + year + month + day + town
    return body + cf_letter(body)


def _with_check(size: int, check: Callable[[str], str | None]) -> Callable[[str, bytes], str]:
    def permuted(c: str, key: bytes) -> str:
        body = permute_valid(c[:size], key, lambda s: check(s) is not None)
        return body + str(check(body))

    return permuted


def _checked(size: int, check: Callable[[str], str | None]) -> Callable[[str], bool]:
    return lambda c: c[:size].isdigit() and c[size:] == check(c[:size])


#: Formats of ten digits and more or fewer that only their check digits tell: digits in all, before the check, its rule.
_BY_CHECK = {"steuer": (11, 10, steuer_digit), "cpf": (11, 9, cpf_digits), "nif": (9, 8, nif_digit), "bsn": (9, 8, bsn_digit)}


def any_number(c: str, key: bytes) -> str:
    """Letters and digits permuted, each in their own places."""
    figures = permute_digits(digits(c), key)
    words = permute_word("".join(x for x in c if not x.isdigit()), LETTERS, key + figures.encode())
    f, w = iter(figures), iter(words)
    return "".join(next(f) if x.isdigit() else next(w) for x in c)


def id_form(value: str, form: str) -> tuple[str, Callable[[str, bytes], str]]:
    """The format of an identity number, found as `form`, and its permutation."""
    c = core(value)
    known = {"ssn": (9, _ssn), "dni": (9, _dni), "nie": (9, _nie), "nino": (9, _nino), "nir": (15, _nir), "cf": (16, _cf)}
    if form == "cued":
        tests = (
            ("nir", re.fullmatch(r"[12]\d{4}(?:\d\d|2[AB])\d{8}", c) and c[13:] == nir_key(c[:13])), ("cf", re.fullmatch(r"[A-Z]{6}\d\d[A-Z]\d\d[A-Z]\d{3}[A-Z]", c) and c[15] == cf_letter(c[:15])),
            ("dni", re.fullmatch(r"\d{8}[A-Z]", c) and c[8] == dni_letter(c[:8])), ("nie", re.fullmatch(r"[XYZ]\d{7}[A-Z]", c) and c[8] == dni_letter(f"{'XYZ'.index(c[0])}{c[1:8]}")), ("nino", re.fullmatch(r"[A-Z]{2}\d{6}[A-D]", c) and _NINO.match(c[:2])),
        )
        form = next((name for name, ok in tests if ok), form)
        for name, (size, body, check) in _BY_CHECK.items():
            if form == "cued" and len(c) == size and c.isdigit() and _checked(body, check)(c):
                return name, _with_check(body, check)
    if form in known and len(c) == known[form][0]:
        return form, known[form][1]
    return "plain", any_number


def pseudo_id(value: str, form: str, key: bytes) -> str:
    name, permuted = id_form(value, form)
    return laid_out(value, permuted(core(value), key + name.encode()))


def phone_number(value: str) -> tuple[str, str, str]:
    """(country code or none, digits behind it, extension): one form for all ways to write a number. Ten digits in the groups of North America have its code."""
    body, _, extension = re.sub(r"(?i)\s*(?:ext\.?|x|durchwahl|poste|int\.|ramal)\s?(\d{1,5})\Z", r"|\1", value).partition("|")
    d = digits(re.sub(r"(?<=\d)[ ]?\(0\)", "", body))
    if body.lstrip("( ").startswith("+") or d.startswith("00"):
        d = d.removeprefix("00")
        code = _COUNTRY.match(d)
        return (code.group(0), d[code.end() :], extension) if code else ("", d, extension)
    if re.fullmatch(r"1?[2-9]\d\d[2-9]\d{6}", d) and re.search(r"\d\)?[ .\-   ]?\d{3}[ .\-   ]\d{4}\Z", body.strip()):
        return "1", d[-10:], extension
    return "", d, extension


def pseudo_phone(value: str, key: bytes) -> str:
    """The number in its one form with all digits behind the country code, or behind a leading zero, permuted."""
    code, number, extension = phone_number(value)
    zero = "0" if not code and number.startswith("0") else ""
    body = zero + permute_digits(number[len(zero) :], key + code.encode() + b"|" + zero.encode())
    tail = f" x{permute_digits(extension, key + body.encode())}" if extension else ""
    return (f"+{code} " if code else "") + body + tail


def pseudo_date(value: str, key: bytes) -> str:
    try:
        return permute_date(dt.date.fromisoformat(value), key).isoformat()
    except ValueError:
        return permute_digits(digits(value), key)
