"""Secrets: three plain patterns, and candidates confirmed by their structure.

Long runs of base64 or hex characters, and bodies between PEM lines, are decoded
and parsed: DER private keys by their nested lengths and field types, OpenSSH
keys by their length-prefixed strings, signed tokens by their JSON header. Only
what parses to its last byte is reported, so random text is not.

Base64 is joined over lines before it is decoded, whether their breaks are real
or written out (`\\n`, `%0A`, ...) and whatever leads them (`> `, `# `, `// `, the
`+` of a diff, quotes); the first line must have 24 characters. How far a key
reaches follows from its own lengths, which are read where they stand: a text is decoded
as a whole only where they fit, so time grows with the text however many candidates it has.
Hex may be led by 0x and cut into bytes or lines. What decodes to text with PEM lines is
scanned in turn, `DEPTH` times at most.

Limits of the forms, besides DEPTH: 24 characters of a first line, 40 of a PEM label, 60
of what leads a line, 64 keys of an OpenSSH file, `MOST_ITEMS` fields of a key.

Spans are in code points, end exclusive, of the whole match. Kinds, in order:
assign, access, hex (the base), der, openssh, jwt (confirmed).

Defined cases: a NULL text is empty and has no spans; repeated rows give
repeated results; texts of any length are scanned whole; an empty table gives an empty
result; other columns do not matter.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import itertools
import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from tidemark.llm.text_map import map_texts

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "der", "openssh", "jwt")
#: How often decoded text is decoded again.
DEPTH = 2
#: Fields of one level of a key; the longest form has 9 and a list of further primes.
MOST_ITEMS = 16
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_LONG = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{24,}+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}+")
_ANY_HEX = re.compile(r"(?<![0-9A-Za-z])(?:0[xX])?((?:[0-9A-Fa-f]{2}){32,}+)(?![0-9A-Za-z])")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}+={0,2}+")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{4,}+\.[A-Za-z0-9_-]*+")
_PEM = re.compile(r"-----BEGIN [A-Z0-9 ]{0,40}-----\s*+((?:[A-Za-z0-9-]++: (?:(?!-----)[^\n])*+\n)*+)\s*+"
                  r"((?:[A-Za-z0-9+/=]++\s*+)++)-----END ")

_WRITTEN = r"\\{1,16}(?:[nrt]|u000[aAdD]|x0[aAdD])|&#(?:10|13|x[aAdD]);|%0[aAdD]|<br ?/?>"
_NOISE = r"(?:[^\w\r\n\\+/=%&<-]|[&<](?!#|br)|\\{1,16}(?=[\"'\s])|\+(?=[\x20\t\r\n]))"
_RUN = re.compile(r"(?:(?!-----)[A-Za-z0-9+/_-]|\\{1,16}/|\\{1,16}u002[bBfF]|%2[bBfF])++")
_RUN_START = re.compile(rf"(?:{_WRITTEN}|-----){{0,8}}+({_RUN.pattern})")
_GAP = re.compile(rf"(?:=|%3[dD]|\\{{1,16}}u003[dD]){{0,2}}(?:{_NOISE}*+(?:\r|\n|{_WRITTEN}))++{_NOISE}*+")
_LEAD = re.compile(rf"(?:^|[\r\n]|{_WRITTEN}){_NOISE}*([+/_-][^\w\r\n\\]*)$")
_ESCAPED = re.compile(r"(?:\\+u00|%)(2[bBfF])")
#: How "-----BEGIN " begins in base64 after 0, 1 or 2 other bytes, and the characters of its group before that.
_BEGIN64 = [(base64.b64encode(b"x" * n + b"-----BEGIN ")[k:14].decode(), k) for n, k in ((0, 0), (1, 2), (2, 3))]
_SEP = r"""(?:[\s:,;"'>#*|]|\\{1,16}[nrx]|0[xX](?=[0-9A-Fa-f]{2}))*+"""
_HH = rf"[0-9A-Fa-f]{{2}}{_SEP}"
_HEX_PAIR = re.compile(rf"{_SEP}([0-9A-Fa-f]{{2}})")
_HEX_DER = re.compile(rf"30{_SEP}(?:[0-7][0-9A-Fa-f]{_SEP}|81{_SEP}{_HH}|82{_SEP}(?:{_HH}){{2}}|83{_SEP}(?:{_HH}){{3}}"
                      rf"|84{_SEP}(?:{_HH}){{4}})(?:02{_SEP}01{_SEP}0[01]|30)")
_HEX_OPENSSH = re.compile(_SEP.join(f"(?:{b:02x}|{b:02X})" for b in b"openssh-key"))
_HEX_BEFORE = re.compile(r"(?:^|[^0-9A-Za-z]|(?:^|[^0-9A-Za-z])0[xX]|\\[nrx])$")


def _decoded64(text: str) -> bytes | None:
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


#: `read(at, n)` gives `n` bytes of a candidate from `at` on, or as many as it has.
Read = Callable[[int, int], bytes]


def _of(data: bytes) -> Read:
    return lambda at, n: data[at:at + n]


def _item(read: Read, at: int) -> tuple[int, int, int] | None:
    """(tag, start, end) of the content of the DER item at `at`, whether or not it ends in the data."""
    head = read(at, 6)
    if len(head) < 2 or head[1] == 0x80 or head[1] > 0x84:
        return None
    n = head[1] - 0x80 if head[1] > 0x80 else 0
    if len(head) < 2 + n:
        return None
    start = at + 2 + n
    return head[0], start, start + (int.from_bytes(head[2:2 + n], "big") if n else head[1])


def _items(read: Read, at: int, end: int, most: int = MOST_ITEMS) -> list[tuple[int, int, int]] | None:
    """The items that fill `at` to `end` exactly; None if they do not, or if there are more than `most`."""
    found = []
    while at < end:
        item = _item(read, at)
        if item is None or item[2] > end or len(found) == most:
            return None
        found.append(item)
        at = item[2]
    return found


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of the items that fill `data` exactly; None if they do not."""
    items = _items(_of(data), 0, len(data), len(data))
    return None if items is None else [(tag, data[start:end]) for tag, start, end in items]


def der_key_end(read: Read) -> int | None:
    """Where a private key of PKCS 1, PKCS 8 (plain or encrypted), SEC 1 or traditional DSA ends, by its
    lengths; None if the data does not begin with one. Reads field headers only."""
    outer = _item(read, 0)
    if outer is None or outer[0] != 0x30:
        return None
    items = _items(read, outer[1], outer[2])
    if not items:
        return None
    tags, sizes = [tag for tag, *_ in items], [end - start for _, start, end in items]
    inside = lambda i: _items(read, *items[i][1:])
    is_key = False
    first = read(items[0][1], 1) if sizes[0] == 1 and tags[0] == 2 else b""
    if first in (b"\0", b"\1") and first:
        if tags[:9] == [2] * 9:  # modulus, exponents, primes, coefficient
            is_key = all(sizes[:9])
        if not is_key and tags == [2] * 6 and first == b"\0":
            p, q, g, y, x = sizes[1:]
            is_key = p > q >= x > 0 and 0 < g <= p >= y > 0  # prime, its divisor, generator, public and private number
        elif not is_key and tags[1:3] == [0x30, 4]:
            algorithm = inside(1)
            is_key = bool(algorithm) and algorithm[0][0] == 6 and sizes[2] > 0
        elif not is_key and len(tags) >= 2 and tags[1] == 4 and sizes[1] >= 16 and first == b"\1":
            is_key = all(tags[i] in (0xA0, 0xA1) and bool(inside(i)) for i in range(2, len(tags)))
    elif tags == [0x30, 4] and sizes[1] >= 16:  # encrypted: algorithm with parameters, then octets
        algorithm = inside(0)
        is_key = bool(algorithm) and len(algorithm) == 2 and algorithm[0][0] == 6 and algorithm[1][0] == 0x30
    return outer[2] if is_key else None


def is_der_key(data: bytes) -> bool:
    return der_key_end(_of(data)) == len(data)


def openssh_end(read: Read) -> int | None:
    """Where the OpenSSH key that the data begins with ends, by its lengths."""
    magic = b"openssh-key-v1\0"
    if read(0, len(magic)) != magic:
        return None
    at, sizes = len(magic), []

    def number() -> int | None:
        four = read(at, 4)
        return int.from_bytes(four, "big") if len(four) == 4 else None

    for _ in range(3):  # cipher, key derivation, its options
        if (n := number()) is None:
            return None
        sizes.append(n)
        at += 4 + n
    n_keys = number()
    at += 4
    if not sizes[0] or n_keys is None or not 1 <= n_keys <= 64:
        return None
    for _ in range(n_keys + 1):  # public keys, then the private part
        if not (n := number()):
            return None
        at += 4 + n
    return at


def is_openssh_key(data: bytes) -> bool:
    return openssh_end(_of(data)) == len(data)


def key_end(read: Read) -> tuple[str, int] | None:
    """Kind and end of the key that the data begins with; the end may lie beyond the data."""
    for kind, end_of in (("der", der_key_end), ("openssh", openssh_end)):
        if (end := end_of(read)) is not None:
            return kind, end
    return None


def is_signed_token(text: str) -> bool:
    parts = text.split(".")
    for part, field in ((parts[0], "alg"), (parts[1], None)):
        raw = _decoded64(part)
        try:
            value = json.loads(raw) if raw else None
        except (ValueError, UnicodeDecodeError, RecursionError):
            return False
        if not isinstance(value, dict) or field and not isinstance(value.get(field), str):
            return False
    return True


def _key_kind(data: bytes | None, depth: int = DEPTH) -> str | None:
    """With a `depth` below DEPTH also of the first key in decoded text with PEM lines."""
    if data is None or len(data) < 24:
        return None
    if depth < DEPTH and b"-----BEGIN " in data:
        inner = _ordered(s for s in confirmed_spans(data.decode("latin-1"), depth + 1) if s[0] != "jwt")
        return inner[0][0] if inner else None
    return "der" if is_der_key(data) else "openssh" if is_openssh_key(data) else None


def _chain(text: str, at: int, lead: str) -> list[tuple[int, int, str]]:
    """(start, end, characters) of the lines of base64 from `at` on; `lead` is taken off those after the first."""
    lines = []
    while run := _RUN.match(text, at):
        plain = _ESCAPED.sub(lambda m: chr(int(m[1], 16)), run[0]).replace("\\", "")
        lines.append((*run.span(), plain))
        gap = _GAP.match(text, run.end())
        if not gap:
            break
        at = gap.end()
        if lead and text.startswith(lead, at):
            at += len(lead)
    return lines


def _keys_in_lines(text: str, lines: list, depth: int) -> list[tuple[str, int, int]]:
    """Keys that begin with a line and end with one, and PEM text anywhere in the lines."""
    found, joined = [], "".join(line for *_, line in lines)
    starts = list(itertools.accumulate((len(line) for *_, line in lines), initial=0))
    ends = {at: i for i, at in enumerate(starts[1:])}

    def padded(end: int) -> int:
        return end + len(re.compile("={0,2}").match(text, end)[0])

    def decoded(at: int, n_chars: int) -> bytes:
        part = joined[at:at + n_chars]
        return _decoded64(part[:len(part) - (len(part) % 4 == 1)]) or b""

    def reader(start: int) -> Read:
        def read(at: int, n: int) -> bytes:
            first = at // 3 * 4
            return decoded(start + first, -(-(at + n) // 3) * 4 - first)[at % 3:at % 3 + n]
        return read

    done = 0
    for i, at in enumerate(starts[:-1]):
        if at < done or not joined.startswith(("M", "b3BlbnNzaC1rZXkt"), at):
            continue
        kind, end = key_end(reader(at)) or (None, 0)
        last = ends.get(at + -(-end * 4 // 3)) if kind else None
        if last is not None and _key_kind(decoded(at, starts[last + 1] - at)) == kind:
            found.append((kind, lines[i][0], padded(lines[last][1])))
            done = starts[last + 1]
    if depth == DEPTH:
        return found
    groups = sorted(m.start() - k for begin, k in _BEGIN64 for m in re.finditer(re.escape(begin), joined))
    for at in {at % 4: at for at in reversed(groups) if at >= 0}.values():  # the first place of each alignment
        inner = decoded(at, len(joined)).decode("latin-1")
        for kind, begin, end in confirmed_spans(inner, depth + 1):
            if kind != "jwt":
                begin = max(inner.rfind("-----BEGIN ", 0, begin), 0)
                close = inner.find("-----", inner.find("-----END ", end) + 9) + 5
                first = bisect.bisect(starts, at + begin * 4 // 3) - 1
                last = bisect.bisect_left(starts, min(at + -(-max(close, end) * 4 // 3), len(joined))) - 1
                found.append((kind, lines[first][0], padded(lines[last][1])))
    return found


def _wrapped_keys(text: str, depth: int) -> list[tuple[str, int, int]]:
    found, at = [], 0
    while start := _RUN_START.search(text, at):
        at = start.end()
        if at - start.start(1) < 24:
            continue
        begin = start.start(1)
        lead = _LEAD.search(text[max(0, begin - 60):begin])
        lines = _chain(text, begin, lead[1] if lead else "")
        found += _keys_in_lines(text, lines, depth)
        # A lead may be of base64 characters itself, as in a diff.
        if (own := re.compile("[+/_-]+").match(text, begin)) and len(own[0]) < 4:
            found += _keys_in_lines(text, _chain(text, own.end(), own[0]), depth)
        at = max(at, lines[-1][1])
    return found


def _hex_keys(text: str) -> list[tuple[str, int, int]]:
    """Keys in hex whose bytes or lines stand apart."""
    found, done, data, begins, ends = [], 0, b"", {}, []
    for head in sorted([*_HEX_DER.finditer(text), *_HEX_OPENSSH.finditer(text)], key=re.Match.start):
        at = head.start()
        if at < done or not _HEX_BEFORE.search(text[max(0, at - 3):at]):
            continue
        if at not in begins:  # all bytes from here on, read once for all heads among them
            data, begins, ends = bytearray(), {}, []
            while pair := _HEX_PAIR.match(text, ends[-1] if ends else at):
                begins[pair.start(1)] = len(data)
                data += bytes.fromhex(pair[1])
                ends.append(pair.end())
        first = begins[at]
        kind, end = key_end(lambda start, n: bytes(data[first + start:first + start + n])) or (None, 0)
        last = first + end - 1 if end >= 24 else len(data)
        if last >= len(data) or re.compile("[0-9A-Za-z]").match(text, ends[last]):
            continue
        found.append((kind, at, ends[last]))
        done = ends[last]  # keys within keys are not told
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    lower = text.lower()
    if any(word in lower for word in _KEYWORDS):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    for run in _LONG.finditer(text):
        found += [("hex", *m.span()) for m in _HEX.finditer(text, *run.span())]
    return found


def confirmed_spans(text: str, depth: int = 0) -> list[tuple[str, int, int]]:
    found, long = [], False
    for run in _LONG.finditer(text):
        long = True
        for m in _JWT.finditer(text, *run.span()):
            if is_signed_token(m[0]):
                found.append(("jwt", *m.span()))
        for m in _BASE64.finditer(text, *run.span()):
            if kind := _key_kind(_decoded64(m[0]), depth):
                found.append((kind, *m.span()))
        for m in _ANY_HEX.finditer(text, *run.span()):
            if kind := _key_kind(bytes.fromhex(m[1]), depth):
                found.append((kind, *m.span(1)))
    if long:
        found += _wrapped_keys(text, depth)
    found += _hex_keys(text)
    if "-----BEGIN " in text:
        for m in _PEM.finditer(text):
            if kind := _key_kind(_decoded64("".join(m[2].split()))):
                found.append((kind, m.start(2), m.start(2) + len(m[2].rstrip())))
    return list(dict.fromkeys(found))


def _ordered(spans) -> list:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def scan_text(text: str | None) -> tuple:
    base = _ordered(base_spans(text or ""))
    spans = _ordered(base + confirmed_spans(text or ""))
    count = [sum(kind == k for kind, _, _ in base) for k in BASE_KINDS]
    return *count, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), len(spans)


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """`id`, counts and digest of the base spans, all spans, and their number; with
    `carry` also `row`, the input's columns."""
    names = ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_spans")

    def start():
        return lambda texts: dict(zip(names, zip(*map(scan_text, texts))))

    return map_texts(docs, id_col, text, start, "n_assign long, n_access long, n_hex long, base_sha256 string, "
                                                "spans string, n_spans long", carry=carry)
