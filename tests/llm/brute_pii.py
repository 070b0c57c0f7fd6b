"""Pseudonyms text by text in plain Python, to compare the registered query with."""

import datetime
import hashlib
import re

from fabricloom.llm import pii

DAY = datetime.date(1800, 1, 1)


def digest(key, kind, i, half):
    return hashlib.sha256(f"{key}|{kind}|{i}|{half}".encode()).hexdigest()


def shifted(half, code, alphabets):
    out = ""
    for k, c in enumerate(half):
        by = int(code[k % 32 * 2 : k % 32 * 2 + 2], 16)
        a = next((a for a in alphabets if c in a), None)
        out += a[(a.index(c) + by) % len(a)] if a else c
    return out


def permuted(value, key, kind, alphabets=(pii.DIGITS, pii.LOWER, pii.UPPER)):
    if len(value) == 1:  # no halves: a permutation of the alphabet
        a = next((a for a in alphabets if value in a), None)
        return a[number(a.index(value), len(a) // 2, 2, key, kind)] if a else value
    cut = len(value) // 2
    a, b = value[:cut], value[cut:]
    for i in range(pii.ROUNDS):
        if i % 2 == 0:
            a = shifted(a, digest(key, kind, i, b), alphabets)
        else:
            b = shifted(b, digest(key, kind, i, a), alphabets)
    return a + b


def number(n, high, low, key, kind):
    a, b = divmod(n, low)
    for i in range(pii.ROUNDS):
        if i % 2 == 0:
            a = (a + int(digest(key, kind, i, b)[:12], 16) % high) % high
        else:
            b = (b + int(digest(key, kind, i, a)[:12], 16) % low) % low
    return a * low + b


def luhn(body):
    total = 0
    for k, c in enumerate(reversed(body)):
        d = int(c) * (2 - k % 2)
        total += d - 9 * (d > 9)
    return str(-total % 10)


def laid_out(m, digits):
    left = iter(digits)
    return "".join(next(left) if c.isdigit() else c for c in m)


def day_of(m):
    p = re.findall("[0-9]+", m)
    order = "ymd" if len(p[0]) == 4 else "dmy" if "." in m else "mdy" if int(p[0]) <= 12 else "dmy"
    y, mo, d = p if order == "ymd" else (p[2], p[0], p[1]) if order == "mdy" else (p[2], p[1], p[0])
    try:
        n = (datetime.date(int(y), int(mo), int(d)) - DAY).days
    except ValueError:
        return order, None
    return order, n if 0 <= n < pii.DAYS_HIGH * pii.DAYS_LOW else None


def one(m, key):
    """The kind and pseudonym of a found string; no kind if it doesn't hold."""
    looks = {k: re.fullmatch(v, m, re.ASCII) for k, v in pii.PATTERNS.items()}
    digits = re.sub("[^0-9]", "", m)
    kind = next(k for k in ("email", "card", "secret", "ip", "date", "ssn", "phone") if looks[k])
    if kind == "email":
        name, domain = m.split("@")
        new = permuted(name.lower(), key, f"email:{domain.lower()}")
        return kind, "".join(x.upper() if c.isupper() else x for c, x in zip(name, new)) + "@" + domain
    if kind == "card":
        if luhn(digits[:-1]) != digits[-1]:
            return None, m
        body = permuted(digits[:-1], key, f"card:{len(digits)}")
        return kind, laid_out(m, body + luhn(body))
    if kind == "secret":
        hexadecimal = re.fullmatch("[0-9a-f]+|[0-9A-F]+", m)
        new = permuted(m.lower(), key, f"secret:{len(m)}", (pii.HEX,)) if hexadecimal else permuted(m, key, f"secret:{len(m)}")
        return kind, new.upper() if hexadecimal and re.search("[A-F]", m) else new
    if kind == "ip":
        o = m.split(".")
        if any(int(x) > 255 or len(x) > 3 for x in o):
            return None, m
        n = number(int.from_bytes(bytes(map(int, o)), "big"), 65536, 65536, key, "ip")
        return kind, ".".join(map(str, n.to_bytes(4, "big")))
    if kind == "date":
        order, n = day_of(m)
        if n is None:
            return None, m
        d = DAY + datetime.timedelta(number(n, pii.DAYS_HIGH, pii.DAYS_LOW, key, "date"))
        mark = re.search("[^0-9]", m)[0]
        wide = order == "ymd" or re.match("[0-9]{2}[^0-9][0-9]{2}[^0-9]", m)
        mo, da = (f"{x:02d}" if wide else str(x) for x in (d.month, d.day))
        return kind, mark.join([f"{d.year:04d}", mo, da] if order == "ymd" else [mo, da, f"{d.year:04d}"] if order == "mdy" else [da, mo, f"{d.year:04d}"])
    if kind == "ssn":
        if re.search("^(000|666|9..)-|-00-|-0000$", m):
            return None, m
        a, g, x = map(int, m.split("-"))
        n = number(((a - 1 - (a > 666)) * 99 + g - 1) * 9999 + x - 1, 898 * 99, 9999, key, "ssn")
        a = n // (99 * 9999) + 1
        return kind, f"{a + (a >= 666):03d}-{n // 9999 % 99 + 1:02d}-{n % 9999 + 1:04d}"
    country = re.match(r"(\+1(?=[0-9]{10}$)|\+[0-9]{1,3}(?=[ .(-]))?", m)[0]
    rest = m[len(country) :]
    digits = re.sub("[^0-9]", "", rest)
    return kind, country + laid_out(rest, permuted(digits, key, f"phone:{len(digits)}"))


def pseudonymised(text, key):
    """The text with what was found replaced, and the kinds."""
    kinds = []

    def put(m):
        kind, new = one(m[0], key)
        kinds.extend([kind] if kind else [])
        return new

    return re.sub(pii.PATTERN, put, text, flags=re.ASCII), kinds
