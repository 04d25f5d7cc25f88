"""Pseudonyms of whole texts in plain Python, for comparison with the operator."""

import datetime
import hashlib
import re

from foliant.llm.pseudonyms import CARD, KINDS, PATTERNS, ROUNDS

START = datetime.date(1900, 1, 1)


class Plain:
    def __init__(self, key):
        self.key = key

    def digest(self, tag, i, v):
        return hashlib.sha256(f"{self.key}|{tag}|{i}|{v}".encode()).hexdigest()

    def permute(self, x, a, b, tag):
        left, right = divmod(x, b)
        for i in range(ROUNDS):
            if i % 2:
                right = (right + int(self.digest(tag, i, left)[:14], 16)) % b
            else:
                left = (left + int(self.digest(tag, i, right)[:14], 16)) % a
        return left * b + right

    def email(self, m):
        local, domain = m.split("@", 1)
        left, right = local[: len(local) // 2], local[len(local) // 2 :]

        def moved(part, by):
            out = ""
            for j, c in enumerate(part):
                v = int(by[2 * j % 64 : 2 * j % 64 + 2], 16)
                base, n = (48, 10) if c.isdigit() else (97, 26) if c.islower() else (65, 26)
                out += chr(base + (ord(c) - base + v) % n) if c.isalnum() else c
            return out

        for i in range(ROUNDS):
            if i % 2:
                right = moved(right, self.digest("email", i, left.lower()))
            else:
                left = moved(left, self.digest("email", i, right.lower()))
        return f"{left}{right}@{domain}"

    def ip(self, m):
        octets = m.split(".")
        if any(int(o) > 255 or (len(o) > 1 and o[0] == "0") for o in octets):
            return None
        x = self.permute(int.from_bytes(bytes(map(int, octets)), "big"), 1 << 16, 1 << 16, "ip")
        return ".".join(map(str, x.to_bytes(4, "big")))

    def date(self, m):
        for form in ("%Y-%m-%d",) if "-" in m else ("%d.%m.%Y",) if "." in m else ("%m/%d/%Y", "%d/%m/%Y"):
            try:
                day = (datetime.datetime.strptime(m, form).date() - START).days
            except ValueError:
                continue
            return (START + datetime.timedelta(self.permute(day, 17, 4297, "date"))).strftime(form)
        return None

    def phone(self, m):
        d = re.sub("[^0-9]", "", m)
        own, million = d[-10:], 10**6
        area, rest = int(own[:3]), int(own[4:])
        if own[0] >= "2" and own[3] >= "2":
            top, low = divmod(self.permute(((area - 200) * 8 + int(own[3]) - 2) * million + rest, 6400, million, "phone"), million)
            new = f"{top // 8 + 200}{top % 8 + 2}{low:06d}"
        elif len(d) == 11 or "(" in m:
            edge = 2000 * million
            y = self.permute(int(own) if area < 200 else edge + ((area - 200) * 2 + int(own[3])) * million + rest, 60_000, 60_000, "phone2")
            top, low = divmod(y - edge, million)
            new = f"{y:010d}" if y < edge else f"{top // 2 + 200}{top % 2}{low:06d}"
        else:
            return None
        return lay(m, d[:-10] + new)

    def ssn(self, m):
        a, b, c = m.split("-")
        if a in ("000", "666") or a[0] == "9" or b == "00" or c == "0000":
            return None
        area = int(a) - 1 - (int(a) > 666)
        top, low = divmod(self.permute((area * 99 + int(b) - 1) * 9999 + int(c) - 1, 898 * 99, 9999, "ssn"), 9999)
        area = top // 99
        return f"{area + 1 + (area > 664):03d}-{top % 99 + 1:02d}-{low + 1:04d}"

    def card(self, m):
        found = re.search(CARD, m)
        lo, hi = found.span() if found else (0, len(m))
        d = re.sub("[^0-9]", "", m[lo:hi])
        if luhn(d):
            return None
        n = len(d) - 2
        body = d[0] + str(self.permute(int(d[1:-1]), 10 ** (n - n // 2), 10 ** (n // 2), "card")).zfill(n)
        return m[:lo] + lay(m[lo:hi], body + next(c for c in "0123456789" if not luhn(body + c))) + m[hi:]

    def text(self, text):
        def one(m):
            for k in KINDS:
                if re.fullmatch(PATTERNS[k], m[0]):
                    return getattr(self, k)(m[0]) or m[0]
            raise AssertionError(m[0])

        return text and re.sub("|".join(PATTERNS[k] for k in KINDS), one, text, flags=re.ASCII)


def luhn(d):
    """The Luhn sum modulo 10."""
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if c > "4" else int(c) * 2) for i, c in enumerate(reversed(d))) % 10


def lay(m, digits):
    it = iter(digits)
    return "".join(next(it) if c in "0123456789" else c for c in m)
