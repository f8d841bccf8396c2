"""A row-at-a-time model of the log engine, written from its definition, for tests to hold the engine against."""

import heapq
import re

ZERO = "0000-00-00T00:00:00.000000000"
B32 = "abcdefghijklmnopqrstuvwxyz234567"
B58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
HEX = "0123456789abcdefABCDEF"
ORDER = ["PEER", "HEIGHT", "INT", "FLOAT", "HASH", "HEX", "IPv4", "IPv4:PORT", "IPv6", "IPv6:PORT", "ONION", "ONION:PORT", "I2P", "I2P:PORT", "BYTES", "DUR", "BECH32", "BASE58"]


def key(line: bytes):
    m = re.match(rb"(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d)", line)
    if not m:
        return None
    head, rest = m[1].decode(), line[19:]
    if rest[:1] != b".":
        return head + "." + "0" * 9
    digits = re.match(rb"[0-9]*", rest[1:])[0].decode()
    return head + "." + digits.ljust(9, "0") if 1 <= len(digits) <= 9 else None


def merge(files: list[tuple[str, list[bytes]]]) -> list[bytes]:
    """A heap over one pending line of each file; files in reader order."""
    out, heap, keys, at = [], [], [ZERO] * len(files), [0] * len(files)

    def push(r):
        if at[r] < len(files[r][1]):
            keys[r] = key(files[r][1][at[r]]) or keys[r]
            heapq.heappush(heap, (keys[r], r))

    for r in range(len(files)):
        push(r)
    while heap:
        _, r = heapq.heappop(heap)
        out.append(files[r][0].encode() + b" " + files[r][1][at[r]])
        at[r] += 1
        push(r)
    return out


def digits(s):
    return bool(s) and all(c in "0123456789" for c in s)


def integer(s):
    return digits(s[1:] if s[:1] in ("+", "-") else s)


def real(s):
    whole, dot, rest = s.partition(".")
    part, e, power = re.match(r"([^eE]*)([eE]?)(.*)", rest, re.S).groups()
    return bool(dot) and integer(whole) and digits(part) and (not e or integer(power))


def port(s):
    return digits(s) and int(s) <= 65535


def v4(s):
    parts = s.split(".")
    return len(parts) == 4 and all(digits(p) and len(p) <= 3 and int(p) <= 255 for p in parts)


def v6(s):
    if ":" not in s or ":::" in s or s.count("::") > 1:
        return False
    parts = s.split(":")
    if not all(len(p) <= 4 and all(c in HEX for c in p) for p in parts):
        return False
    return sum(map(bool, parts)) <= 7 if "::" in s else len(parts) == 8


def v6port(s):
    m = re.fullmatch(r"\[([^\]]*)\]:(.*)", s, re.S)
    return bool(m) and v6(m[1]) and port(m[2])


def named(s, suffix, sizes):
    return s.endswith(suffix) and len(s) - len(suffix) in sizes and all(c in B32 for c in s[: -len(suffix)])


def with_port(test):
    return lambda s: ":" in s and port(s.rsplit(":", 1)[1]) and test(s.rsplit(":", 1)[0])


def kind(atom, following):
    onion = lambda s: named(s, ".onion", (16, 56))
    i2p = lambda s: named(s, ".b32.i2p", (52,))
    unit = next((u for u in ("μs", "ns", "us", "ms", "s", "m", "h", "d") if atom.endswith(u) and (integer(atom[: -len(u)]) or real(atom[: -len(u)]))), None)
    tests = [
        ("PEER", atom.startswith("peer=") and integer(atom[5:])),
        ("HEIGHT", atom.startswith("height=") and digits(atom[7:])),
        ("BYTES", digits(atom) and following == "bytes"),
        ("HASH", len(atom) == 64 and all(c in "0123456789abcdef" for c in atom)),
        ("DUR", unit is not None),
        ("IPv6:PORT", v6port(atom)),
        ("IPv6", v6(atom)),
        ("IPv4:PORT", with_port(v4)(atom)),
        ("IPv4", v4(atom)),
        ("ONION:PORT", with_port(onion)(atom)),
        ("ONION", onion(atom)),
        ("I2P:PORT", with_port(i2p)(atom)),
        ("I2P", i2p(atom)),
        ("BECH32", any(atom.startswith(p) and len(atom) >= len(p) + 6 and all(c in BECH for c in atom[len(p) :]) for p in ("bc1", "tb1", "bcrt1"))),
        ("HEX", (atom[:2] == "0x" and len(atom) > 2 and all(c in HEX for c in atom[2:])) or (8 <= len(atom) <= 63 and all(c in HEX for c in atom) and any(c.isalpha() for c in atom))),
        ("BASE58", 26 <= len(atom) <= 35 and all(c in B58 for c in atom) and any(c.isalpha() for c in atom)),
        ("FLOAT", real(atom)),
        ("INT", integer(atom)),
    ]
    return next((k for k, ok in tests if ok), None)


def atoms(content):
    out = []
    for word in re.split(r"[ \t\n\f\r]+", content):
        tail = ""
        if len(word) > 1 and word[-1] in ":,":
            word, tail = word[:-1], word[-1]
        if word.startswith(("peer=", "height=")):
            out.append(word)
        else:
            begin = i = 0
            while i < len(word):
                if i == begin and word[i] == "[":
                    m = re.match(r"\[([^\]]*)\]:([0-9]+)", word[i:])
                    if m and v6(m[1]) and port(m[2]):
                        out.append(m[0])
                        begin = i = i + len(m[0])
                        continue
                if word[i] in "=()[]'/":
                    out += [word[begin:i]] if begin < i else []
                    out.append(word[i])
                    begin = i + 1
                i += 1
            out += [word[begin:]] if begin < len(word) else []
        out += [tail] if tail else []
    return out


def tokens(content):
    a, out, i = atoms(content), [], 0
    while i < len(a):
        following = a[i + 1] if i + 1 < len(a) else ""
        k = kind(a[i], following)
        out.append((k, a[i]))
        i += 2 if k == "BYTES" else 1
    return out


def slots(content):
    return tuple("0" + t if k is None else f"1{ORDER.index(k):02d}" for k, t in tokens(content))


def rendered(template):
    return " ".join("<*>" if s == "2" else f"<{ORDER[int(s[1:])]}>" if s[0] == "1" else s[1:] for s in template)


class Clusters:
    """One category's tree, a line at a time."""

    def __init__(self, depth, threshold):
        self.depth, self.threshold, self.next, self.leaves = max(depth, 2), threshold, 1, {}

    def leaf(self, slots):
        return self.leaves.setdefault((len(slots), tuple(slots[: self.depth - 2])), [])

    def load(self, id, template, count, first, last):
        self.next = max(self.next, min(id + 1, 2**64 - 1))
        self.leaf(template).append([id, list(template), count, first, last])

    def add(self, slots, stamp):
        leaf, best, most = self.leaf(slots), None, 0.0
        for c in leaf:
            alike = sum(a in ("2", b) for a, b in zip(c[1], slots, strict=True)) / len(slots) if slots else 1.0
            if alike > most:
                best, most = c, alike
        if best is not None and most >= self.threshold:
            best[1] = [a if a in ("2", b) else "2" for a, b in zip(best[1], slots, strict=True)]
            best[2] += 1
            if stamp is not None:
                best[3] = stamp if best[3] is None else min(best[3], stamp)
                best[4] = stamp if best[4] is None else max(best[4], stamp)
            return
        leaf.append([self.next, list(slots), 1, stamp, stamp])
        self.next = min(self.next + 1, 2**64 - 1)

    def all(self):
        return [(c[0], tuple(c[1]), c[2], c[3], c[4]) for leaf in self.leaves.values() for c in leaf]
