"""Text decoded with the wrong character encoding (problem 10).

1. Letter-pair frequencies (in how many records each pair of neighbouring characters occurs, in a fixed number of hash
   slots) say how usual a piece of text is. They are smoothed with a fixed prior over kinds of characters (a letter
   followed by a sign is odd, letters of one script in a row are not), so that small collections are judged alike.
2. Pieces (lines and sentences) with unusual stretches are joined with usual ones on their text stripped of non-ASCII
   characters. Where such near-twins differ, the differing stretches are aligned, and the pairs of encodings that turn one
   into the other are learned. Stretches without a twin teach the transformation under which all their bytes are valid and
   the outcome is far more usual: one such stretch is enough.
3. The learned transformations are applied to every record: a stretch is taken back where its bytes are valid in the
   other encoding and the result is far more usual than what stands there; again, up to ``ROUNDS`` times, for text garbled
   more than once. Characters that were lost (U+FFFD, what a decoder writes for bytes that are not valid in the encoding it
   was told, so a proof by itself) are filled in from the most frequent word of the same stripped form.

The driver holds the slot table, one bit per hash slot of the unusual pieces' keys, and the list of transformations; none
grows with the data. All records are counted, searched, learned from and repaired; all of a batch's characters are scored
at once, and only lines that a transformation can fit are tried one by one.
"""

from __future__ import annotations

import codecs
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunefold import shared

SLOTS = 1 << 20
KEY_BITS = 1 << 22
ROUNDS = 12
GAIN, GAIN_UTF8, GAIN_ALONE = 9.0, 1.0, 25.0
UNUSUAL, UNUSUAL_NARROW = -6.5, -4.5
WEIGHT = 20.0
ASCII_PAIR = -4.0
AROUND = 8
LOST = "�"
SINGLE = ("cp1252", "cp1251", "cp1250", "cp1253", "cp1254", "cp1257", "koi8_r", "cp866", "mac_roman", "mac_cyrillic", "cp437", "cp850", "iso8859_2", "iso8859_5", "iso8859_7", "iso8859_15")
MULTI = ("utf_8", "gb18030", "big5", "cp932", "euc_jp", "cp949")
_PIECE = re.compile(r"[^\n]+?(?:[.!?]+(?=\s)|(?=\n)|\Z)")
_UTF8_RUN = re.compile(rb"(?:[\xe2-\xef][\x80-\xbf]{2}){2}|(?:[\xc3-\xd1][\x80-\xbf]){3}")


@lru_cache(None)
def _table(codec: str) -> dict[str, bytes]:
    """Character to byte of a one-byte codec; bytes that it leaves undefined stand for the control of the same number."""
    out: dict[str, bytes] = {}
    free = []
    for b in range(256):
        try:
            out.setdefault(bytes([b]).decode(codec), bytes([b]))
        except UnicodeDecodeError:
            free.append(b)
    for b in free:
        out.setdefault(chr(b), bytes([b]))
    if codec == "cp1252":  # controls as such too: the same text is often read as ISO 8859-1
        for b in range(0x80, 0xA0):
            out.setdefault(chr(b), bytes([b]))
    return out


@lru_cache(200_000)
def _bytes_of(ch: str, codec: str) -> bytes | None:
    if codec in SINGLE:
        return _table(codec).get(ch)
    try:
        return ch.encode(codec)
    except UnicodeEncodeError:
        return None


@lru_cache(None)
def _chars(codec: str) -> list[str]:
    back = {v: k for k, v in reversed(list(_table(codec).items()))}
    return [back.get(bytes([b]), LOST) for b in range(256)]


_STEP = {
    "utf_8": re.compile(rb"[\x00-\x7f]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}|.", re.S),
    "gb18030": re.compile(rb"[\x00-\x7f]|[\x81-\xfe][\x40-\x7e\x80-\xfe]|.", re.S),
    "big5": re.compile(rb"[\x00-\x7f]|[\xa1-\xf9][\x40-\x7e\xa1-\xfe]|.", re.S),
    "cp932": re.compile(rb"[\x00-\x7f]|[\xa1-\xdf]|[\x81-\x9f\xe0-\xfc][\x40-\x7e\x80-\xfc]|.", re.S),
    "euc_jp": re.compile(rb"[\x00-\x7f]|\x8e[\xa1-\xdf]|[\xa1-\xfe][\xa1-\xfe]|.", re.S),
    "cp949": re.compile(rb"[\x00-\x7f]|[\x81-\xfe][\x41-\xfe]|.", re.S),
}


def _decode(raw: bytes, codec: str) -> tuple[list[str], list[int]]:
    """Characters and the byte each starts at; what isn't valid becomes U+FFFD."""
    if codec in SINGLE:
        t = _chars(codec)
        return [t[b] for b in raw], list(range(len(raw)))
    chars, starts = [], []
    for m in _STEP[codec].finditer(raw):
        piece = m[0]
        chars.append(_char(piece, codec))
        starts.append(m.start())
    return chars, starts


@lru_cache(200_000)
def _char(piece: bytes, codec: str) -> str:
    try:
        c = piece.decode(codec)
        return c if len(c) == 1 else LOST
    except UnicodeDecodeError:
        return LOST


# Bytes that begin and go on with a character, per encoding of several bytes.
_RANGES = {
    "utf_8": ([(0xC2, 0xF4)], [(0x80, 0xBF)]),
    "gb18030": ([(0x81, 0xFE)], [(0x80, 0xFE)]),
    "big5": ([(0xA1, 0xF9)], [(0x40, 0x7E), (0xA1, 0xFE)]),
    "cp932": ([(0x81, 0x9F), (0xE0, 0xFC)], [(0x40, 0x7E), (0x80, 0xFC)]),
    "euc_jp": ([(0xA1, 0xFE)], [(0xA1, 0xFE)]),
    "cp949": ([(0x81, 0xFE)], [(0x80, 0xFE)]),
}


@lru_cache(None)
def _gate(wrong: str, right: str) -> re.Pattern:
    """What must stand in a text read with a one-byte codec if it was written in one of several bytes."""
    by_byte: dict[int, list[str]] = {}
    for c, b in _table(wrong).items():
        by_byte.setdefault(b[0], []).append(c)

    def chars(ranges):
        return "[" + "".join(re.escape(c) for a, b in ranges for x in range(a, b + 1) for c in by_byte.get(x, [])) + "]"

    if right == "utf_8":  # whole characters of two, three and four bytes
        rest = chars([(0x80, 0xBF)])
        return re.compile(f"{chars([(0xC2, 0xDF)])}{rest}|{chars([(0xE0, 0xEF)])}{rest}{{2}}|{chars([(0xF0, 0xF4)])}{rest}{{3}}")
    return re.compile("(?:" + "".join(chars(r) for r in _RANGES[right]) + "){2}")


# ---------------------------------------------------------------- how usual

# Kinds of characters: 0 space, 1 digit, 2 capital and 3 small ASCII letter, 4 ASCII sign, 5 small and 6 capital Latin
# letter beyond ASCII, 7 small and 8 capital letter of another alphabet with case, 9 common and 10 rare ideograph, 11 kana,
# 12 wide sign, 13 dash or quotation mark, 14 other sign, 15 control, private or unassigned, 16 Hangul, 17 narrow kana,
# 18 other letter, 19 sign that opens.
_SHARE = (1 / 4, 1 / 10, 1 / 26, 1 / 26, 1 / 30, 1 / 60, 1 / 60, 1 / 33, 1 / 33, 1 / 3500, 1 / 20000, 1 / 160, 1 / 20, 1 / 15, 1 / 60, 1 / 40, 1 / 2000, 1 / 60, 1 / 500, 1 / 15)
_LETTERS = ({2, 3, 5, 6}, {7, 8}, {9, 10, 11}, {16}, {17}, {18})
_QUOTES, _OPENING = set("–—‘’“”…»›·•№"), set("„«‹¡¿")


def _kind(cp: int) -> int:
    c = chr(cp)
    if cp < 128:
        return 0 if c.isspace() else 1 if c.isdigit() else 2 if c.isupper() else 3 if c.islower() else 4
    cat = unicodedata.category(c)
    if cp == 0xFFFD or cat[0] == "C":
        return 15
    if c in _QUOTES or c in _OPENING:
        return 13 if c in _QUOTES else 19
    if 0xFF61 <= cp <= 0xFF9F:
        return 17
    if 0x3040 <= cp <= 0x30FF or cp == 0x3005:
        return 11
    if 0xAC00 <= cp <= 0xD7A3:
        return 16
    if 0x3400 <= cp <= 0x9FFF:
        return 9 if _common(c) else 10
    if 0x3000 <= cp <= 0x303F or 0xFF01 <= cp <= 0xFF60:
        return 12
    if cat in ("Lu", "Ll"):
        latin = unicodedata.name(c, "").startswith("LATIN")
        return (5 if cat == "Ll" else 6) if latin else (7 if cat == "Ll" else 8)
    return 18 if cat[0] == "L" and c not in "ªº" else 14


def _common(c: str) -> bool:
    """On the first level of one of the national sets."""
    for codec, lo, hi in (("gb2312", 0xB0, 0xD7), ("cp932", 0x88, 0x97), ("big5", 0xA4, 0xC6)):
        try:
            if lo <= c.encode(codec)[0] <= hi:
                return True
        except UnicodeEncodeError:
            pass
    return False


def _plausible(a: int, b: int) -> float:
    """How readily kind b follows kind a: 1 natural, 0.1 neutral, 0.002 odd."""
    if 15 in (a, b):
        return 0.002
    if (a, b) in ((10, 10), (5, 6), (3, 6), (7, 8), (3, 2), (5, 2)):
        return 0.002
    if b == 19 and (a in (2, 3) or 5 <= a <= 8):
        return 0.002
    if b in (0, 4, 12) or a in (0, 4, 12):
        return 1.0 if b < 14 or b in (16, 18, 19) else 0.1
    if (a, b) in ((1, 14), (14, 0), (14, 1)) or {13, 19} & {a, b} and 14 not in (a, b):
        return 0.1
    if (a, b) in ((5, 5), (2, 5), (3, 5), (6, 6), (10, 9), (9, 10), (6, 5)):
        return 0.1
    for s in _LETTERS:
        if a in s and b in s:
            return 1.0
    if {a, b} & {9, 10, 11, 16} and {a, b} & {1, 2, 3}:
        return 0.1
    return 0.1 if {a, b} <= {1, 2, 3, 4} else 0.002


@lru_cache(None)
def _kinds():
    """Kind of each code point of the first plane; prior of the follower and whether it is odd, per pair of kinds."""
    import numpy as np

    kinds = np.array([_kind(cp) for cp in range(1 << 16)], "u1")
    level = np.array([[_plausible(a, b) for b in range(20)] for a in range(20)], "f4")
    return kinds, (level * np.array(_SHARE, "f4")[None] * np.float32(WEIGHT)).reshape(-1), (level < 0.01).reshape(-1)


class Usual:
    """How usual neighbouring characters are, from hashed record counts and the prior."""

    def __init__(self, packed: bytes) -> None:
        import numpy as np
        import zstandard

        self.n = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), "f4")
        self.kinds, self.prior, self.odd = _kinds()

    def scored(self, a, b):
        """log P(b | a) and whether the pair is odd by kind, for arrays of code points with a non-ASCII one in each pair."""
        import numpy as np

        kind = self.kinds[np.minimum(a, 0xFFFF)].astype("i4") * 20 + self.kinds[np.minimum(b, 0xFFFF)]
        lp = np.log(self.n[_slots(a, b)] + self.prior[kind]) - np.log(self.n[_slots(a, 0)] + np.float32(WEIGHT))
        return lp, self.odd[kind]

    def pairs(self, points):
        """log P(next | this) for neighbours of an array of code points; ASCII pairs count as one constant."""
        import numpy as np

        a, b = points[:-1], points[1:]
        out = np.full(len(a), ASCII_PAIR, "f4")
        at = np.flatnonzero((a | b) > 127)
        if len(at):
            out[at] = self.scored(a[at], b[at])[0]
        return out


def _slots(a, b):
    import numpy as np

    x = a.astype("u8") << np.uint64(21)
    x |= np.asarray(b).astype("u8")
    x += np.uint64(1)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC2B2AE3D27D4EB4F)
    return (x >> np.uint64(44)).astype("i4")


def _points(s: str):
    import numpy as np

    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), "<i4")


def _digits(p):
    """Digits count as one character, any white space as a space."""
    import numpy as np

    p = np.where((p >= 48) & (p <= 57), 48, p)
    return np.where((p >= 9) & (p <= 13), 32, p)


def _score(usual: Usual, s: str):
    return usual.pairs(_digits(_points(s)))


def _count_pairs(batches: Iterator) -> Iterator:
    """In how many records each pair with a non-ASCII character, and each character, occurs."""
    import numpy as np
    import pyarrow as pa

    total = np.zeros(SLOTS, "i8")
    for b in batches:
        texts = [t for t in b.column(0).to_pylist() if t]
        for lo in range(0, len(texts), 2000):
            part = texts[lo : lo + 2000]
            p = _digits(_points("\n" + "\n".join(part) + "\n"))
            ends = np.cumsum([len(t) + 1 for t in part])
            at = np.flatnonzero((p[:-1] | p[1:]) > 127)
            doc = np.searchsorted(ends, at, "right").astype("i8")
            seen = [(doc << 20) | _slots(p[at], p[at + 1]), (doc << 20) | _slots(p[at], 0)]
            small = p[1:-1] < 128
            where = np.repeat(np.arange(len(part)), [len(t) + 1 for t in part])[: len(small)][small]
            ascii_ = np.zeros((len(part), 128), bool)
            ascii_[where, p[1:-1][small]] = True
            total[_slots(np.arange(128), 0)] += ascii_.sum(0)
            high = p[at] > 127
            seen[1] = seen[1][high]
            for x in seen:
                x.sort()
                if len(x):
                    x = x[np.r_[True, x[1:] != x[:-1]]] & ((1 << 20) - 1)
                    total += np.bincount(x, minlength=SLOTS)
    some = np.flatnonzero(total)
    yield pa.record_batch([pa.array(some.astype("i4")), pa.array(total[some])], names=["slot", "n"])


# ---------------------------------------------------------------- unusual lines


class Line:
    """A line with unusual stretches: its record's number in the batch, its text, the stretches and how low the pairs lie."""

    __slots__ = ("row", "text", "spans", "odd")

    def __init__(self, row: int, text: str, spans: list[tuple[int, int]], odd: bool) -> None:
        self.row, self.text, self.spans, self.odd = row, text, spans, odd


def unusual_lines(texts: list[str], usual: Usual) -> list[Line]:
    """All lines with an unusual neighbourhood of a non-ASCII character, by frequency or by kind: where garbling may begin.
    ``odd`` says whether one of the pairs is odd by kind."""
    import numpy as np

    joined = "\n".join(texts)
    raw = _points(f"\n{joined}\n")
    p = _digits(raw)
    at = np.flatnonzero((p[:-1] | p[1:]) > 127)
    if not len(at):
        return []
    lp, odd = usual.scored(p[at], p[at + 1])
    wide = np.maximum(p[at], p[at + 1]) >= 0x2E80
    low = odd | (lp < np.where(wide, UNUSUAL, UNUSUAL_NARROW))
    at, odd = at[low], odd[low]
    if not len(at):
        return []
    breaks = np.flatnonzero(raw == 10)  # the first one stands before the first line
    line = np.searchsorted(breaks, at, "right") - 1
    ends = np.cumsum([len(t) + 1 for t in texts])
    cut = np.flatnonzero((np.diff(at) > 12) | (np.diff(line) > 0)) + 1
    first, last = np.r_[0, cut], np.r_[cut, len(at)] - 1
    lo, hi, of = at[first] - 1, at[last] + 1, line[first]
    any_odd = np.logical_or.reduceat(odd, first)
    out: list[Line] = []
    begins, rows = breaks[of], np.searchsorted(ends, breaks[of], "right")
    stops = breaks[of + 1]
    for a, b, begin, stop, row, o in zip(lo.tolist(), hi.tolist(), begins.tolist(), stops.tolist(), rows.tolist(), any_odd.tolist()):
        size = stop - begin - 1
        span = (max(0, a - begin - 1 + 1), min(size, b - begin))
        if out and out[-1].row == row and out[-1].spans is not None and last_begin == begin:
            out[-1].spans.append(span)
            out[-1].odd |= o
        else:
            out.append(Line(row, joined[begin : stop - 1], [span], o))
        last_begin = begin
    return out


@lru_cache(None)
def _mapped(wrong: str, right: str):
    """Per code point of the first plane what a one-byte pair makes of it; 0 where the first codec lacks it."""
    import numpy as np

    out = np.zeros(1 << 16, "i4")
    there = _chars(right)
    for c, b in _table(wrong).items():
        if ord(c) < 1 << 16 and there[b[0]] != LOST:
            out[ord(c)] = ord(there[b[0]])
    return out


def _fitting(lines: list[Line], learned: list[tuple[str, str]], usual: Usual) -> list[list[tuple[str, str]]]:
    """For each line the transformations that can fit it: the bytes of their characters stand there, or, where one byte
    stays one character, some stretch of the line gains enough."""
    import numpy as np

    fits: list[list[tuple[str, str]]] = [[] for _ in lines]
    if not lines:
        return fits
    simple = [t for t in learned if t[0] in SINGLE and t[1] in SINGLE]
    gains = {}
    if simple:
        p = _digits(_points("\n" + "\n".join(x.text for x in lines) + "\n"))
        sizes = np.array([len(x.text) + 1 for x in lines])
        begins = np.cumsum(sizes) - sizes
        number = np.repeat(np.arange(len(lines)), sizes)
        old = usual.pairs(p)[: len(number)]
        bmp = np.minimum(p, 0xFFFF)
        for t in simple:
            q = np.where(p == 32, 32, _mapped(*t)[bmp])
            net = usual.pairs(np.where(q > 0, q, p))[: len(number)] - old
            net[(q[:-1] == 0)[: len(number)] | (q[1:] == 0)[: len(number)]] -= 50.0
            c = np.cumsum(net, dtype="f8") - number * 1e7  # a new line begins far below all before it
            before = np.concatenate([[0.0], c[:-1]])
            before[begins] = np.concatenate([[0.0], c[begins[1:] - 1]]) - 1e7 * (np.arange(len(lines)) > 0)
            gains[t] = np.maximum.reduceat(c - np.minimum.accumulate(before), begins) >= GAIN
    gates = [(t, _gate(*t) if t[0] in SINGLE and t[1] in MULTI else None) for t in learned]
    for k, x in enumerate(lines):
        raws: dict[str, bytes] = {}
        for t, gate in gates:
            if t in gains:
                ok = gains[t][k]
            elif gate is not None:
                ok = gate.search(x.text, max(0, x.spans[0][0] - 8), x.spans[-1][1] + 8)
            else:
                raw = raws.get(t[0])
                if raw is None:
                    raw = raws[t[0]] = x.text.encode(t[0], "ignore")
                ok = _UTF8_RUN.search(raw) if t[1] == "utf_8" else any(len(_bytes_of(c, t[0]) or b"") > 1 for c in x.text)
            if ok:
                fits[k].append(t)
    return fits


class Repairer:
    """Finds and takes back what learned transformations explain."""

    def __init__(self, packed: bytes, learned: list[tuple[str, str]]) -> None:
        self.usual, self.learned = Usual(packed), learned

    def found(self, texts: list[str]) -> list[bool]:
        """Which of the texts hold a garbled stretch: the first that a transformation explains decides."""
        out = [LOST in t for t in texts]
        some = [i for i, t in enumerate(texts) if not out[i] and not t.isascii()]
        lines = unusual_lines([texts[i] for i in some], self.usual)
        for x, fits in zip(lines, _fitting(lines, self.learned, self.usual)):
            i = some[x.row]
            if not out[i] and any(next(self._tries(x.text, x.spans, *t), None) for t in fits):
                out[i] = True
        return out

    def restored(self, texts: list[str]) -> list[tuple[str, list[str]]]:
        """The texts with the stretches taken back, and the transformations used, in order."""
        used: list[list[str]] = [["lost"] if LOST in t else [] for t in texts]
        held = [t.split("\n") for t in texts]
        open_ = [(i, k) for i, t in enumerate(texts) if not t.isascii() for k, s in enumerate(held[i]) if not s.isascii()]
        for _ in range(ROUNDS):
            lines = unusual_lines([held[i][k] for i, k in open_], self.usual)
            left = []
            for x, fits in zip(lines, _fitting(lines, self.learned, self.usual)):
                fixes = self._best(x, fits)
                if fixes:
                    i, k = open_[x.row]
                    s = x.text
                    for _, a, b, new, how in sorted(fixes, key=lambda f: -f[1]):
                        s = s[:a] + new + s[b:]
                        used[i].append(how)
                    held[i][k] = s
                    left.append((i, k))
            if not left:
                break
            open_ = left
        return [("\n".join(h), u) for h, u in zip(held, used)]

    def _best(self, x: Line, fits: list[tuple[str, str]]) -> list[tuple]:
        """The stretches of the transformation that gains most on this line."""
        best, most = [], 0.0
        for t in fits:
            fixes = list(self._tries(x.text, x.spans, *t))
            gain = sum(f[0] for f in fixes)
            if gain > most + 1e-6:
                best, most = fixes, gain
        return best

    def _tries(self, line: str, spans, wrong: str, right: str) -> Iterator[tuple]:
        import numpy as np

        done = -1
        for lo, hi in spans:
            if lo < done:
                continue
            near = line[max(0, lo - 8) : hi + 8]
            if wrong in SINGLE:
                if right in MULTI and not _gate(wrong, right).search(near):
                    continue  # no bytes there that could be it
            elif right == "utf_8" and not _UTF8_RUN.search(near.encode(wrong, "ignore")):
                continue
            probe = next((k for k in range(lo, hi) if ord(line[k]) > 127 and _bytes_of(line[k], wrong)), None)
            if probe is None:
                continue
            i = probe
            while i > 0 and (b := _bytes_of(line[i - 1], wrong)) and (ord(line[i - 1]) > 127 or probe - i < 64):
                i -= 1
            j = probe + 1
            while j < len(line) and j < hi + 64 and _bytes_of(line[j], wrong):
                j += 1
            done = j
            seg = line[i:j]
            raw = [_bytes_of(c, wrong) for c in seg]
            sizes = np.array([len(r) for r in raw])
            gstart = np.cumsum(sizes) - sizes
            total = int(sizes.sum())
            chars, fstart = _decode(b"".join(raw), right)
            left, follow = line[i - 1] if i else " ", line[j] if j < len(line) else " "
            g = _score(self.usual, left + seg + follow)
            f = _score(self.usual, left + "".join(chars) + follow)
            f = f - np.array([25.0 if c == LOST or right != "utf_8" and "\x80" <= c < "\xa0" else 0.0 for c in chars] + [0.0])
            fstart = np.array(fstart + [total])
            net = np.bincount(fstart, f, total + 1) - np.bincount(np.append(gstart, total), g, total + 1)
            # the stretch of bytes that gains most
            cum = np.concatenate([[0.0], np.cumsum(net)])
            low = np.minimum.accumulate(cum[:-1])
            end = int(np.argmax(cum[1:] - low))
            least = GAIN_UTF8 if right == "utf_8" and wrong in SINGLE else GAIN
            if cum[end + 1] - low[end] < least:
                continue
            start = int(np.argmin(cum[: end + 1]))
            gs = np.append(gstart, total)
            both = np.intersect1d(gs, fstart, assume_unique=True)
            s = both[np.searchsorted(both, start, "right") - 1]
            e = both[min(np.searchsorted(both, end, "left"), len(both) - 1)]
            if e <= s:
                continue
            a, b = int(np.searchsorted(gs, s)), int(np.searchsorted(gs, e))
            old, new = seg[a:b], "".join(chars[int(np.searchsorted(fstart, s)) : int(np.searchsorted(fstart, e))])
            if old == new or old.isascii() or new.isascii() and len(old) < 3:
                continue
            ctx = ((line[i + a - 1] if i + a else " "), (line[i + b] if i + b < len(line) else " "))
            after, before = _score(self.usual, ctx[0] + new + ctx[1]), _score(self.usual, ctx[0] + old + ctx[1])
            sure = float(after.sum() - before.sum())
            if sure < least or new.count(LOST) * 4 > len(new):
                continue
            # by chance only: few characters, none of them usual next to each other
            if (after > UNUSUAL).mean() < 0.5 and not _still_garbled(new):
                continue
            yield sure, i + a, i + b, new, f"{right}>{wrong}"


def _still_garbled(s: str) -> str | None:
    """What lies one more layer below, if these are still the bytes of a text in UTF-8."""
    raw = [_bytes_of(c, "cp1252") for c in s]
    if None in raw:
        return None
    try:
        below = b"".join(raw).decode("utf_8")
    except UnicodeDecodeError:
        return None
    return below if len(below) < len(s) else None


# ---------------------------------------------------------------- learning


def strip_key(piece: str) -> str:
    """The piece with each run of non-ASCII characters stripped to a mark, digits alike."""
    return re.sub(r"\d", "0", re.sub(r"[^\x00-\x7f]+", "\x7f", piece)).strip()


def framed(key: str) -> bool:
    """Whether what is left of a piece is enough to know it by: its letters outnumber the marks three times, eight at least."""
    letters = sum(map(str.isalpha, key))
    return letters >= 8 and letters >= 3 * key.count("\x7f")


def _key_slot(key: str) -> int:
    from hashlib import blake2b

    return int.from_bytes(blake2b(key.encode(), digest_size=8).digest(), "big") % KEY_BITS


def _suspects(packed: bytes):
    """(kind, piece, key): of the unusual lines, ``f`` for a framed piece to be joined, ``s`` for a stretch and its neighbours."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        usual = Usual(packed)
        for b in batches:
            texts = [t for t in b.column(0).to_pylist() if t and not t.isascii()]
            out: set[tuple] = set()
            for lo in range(0, len(texts), 2000):
                for x in unusual_lines(texts[lo : lo + 2000], usual):
                    if not x.odd and not any(_NARROW.search(x.text, a, e) for a, e in x.spans):
                        continue
                    runs = [m.span() for m in _RUN.finditer(x.text)]
                    for a, e in x.spans:
                        for start, end in runs:
                            if a < end and e > start:
                                out.add(("s", re.sub(r"\d", "0", x.text[max(start - 2, a - AROUND, 0) : min(end + 2, e + AROUND)]), ""))
                    for m in _PIECE.finditer(x.text):
                        if any(a < m.end() and e > m.start() for a, e in x.spans) and framed(key := strip_key(m[0])):
                            out.add(("f", re.sub(r"\d", "0", m[0].strip()), key))
            cols = list(zip(*out)) or [(), (), ()]
            yield pa.record_batch([pa.array(c, pa.string()) for c in cols], names=["kind", "piece", "key"])

    return run


_NARROW = re.compile("[\x80-\xb6\xb8-῿⁰-ⷿ]")


def _clean(bits: bytes):
    """(key, piece) of all pieces whose key an unusual piece may have."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import zstandard

        wanted = np.unpackbits(np.frombuffer(zstandard.ZstdDecompressor().decompress(bits), "u1")).tobytes()
        for b in batches:
            out = set()
            for t in b.column(0).to_pylist():
                if t and not t.isascii():
                    for m in _PIECE.finditer(t):
                        s = m[0]
                        # a framed piece has eight ASCII characters at least
                        if not s.isascii() and len(s.encode("ascii", "ignore")) >= 8 and wanted[_key_slot(key := strip_key(s))]:
                            out.add((key, re.sub(r"\d", "0", s.strip())))
            cols = list(zip(*out)) or [(), ()]
            yield pa.record_batch([pa.array(c, pa.string()) for c in cols], names=["key", "piece"])

    return run


def align(odd: str, plain: str) -> tuple[str, str] | None:
    """The differing stretches of two near-twins; digits may differ."""
    a, b = re.sub(r"\d", "0", odd), re.sub(r"\d", "0", plain)
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    j = 0
    while j < min(len(a), len(b)) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    x, y = a[i : len(a) - j], b[i : len(b) - j]
    return (x, y) if x and y and not x.isascii() and not y.isascii() else None


def transformations(x: str, y: str) -> list[tuple[str, str]]:
    """The pairs (codec it was read with, codec it was written in) under which the stretches x and y have the same bytes.

    Where several bytes make a character, a quarter of the bytes may differ: the ends of a stretch get lost in garbling.
    """
    read = {c: b for c in SINGLE + MULTI if (b := _encoded(x, c))}
    written = {c: b for c in SINGLE + MULTI if (b := _encoded(y, c))}
    out = []
    for wrong, raw in read.items():
        for right, own in written.items():
            if wrong != right and (raw == own or right in MULTI and len(own) >= 6 and _shared(raw, own) * 4 >= 3 * max(len(own), len(raw))):
                out.append((wrong, right))
    return out


def _encoded(s: str, codec: str) -> bytes | None:
    raw = [b"\xff" if c == LOST else _bytes_of(c, codec) for c in s]
    return None if None in raw else b"".join(raw)


def _shared(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    i = next((k for k in range(n) if a[k] != b[k]), n)
    j = next((k for k in range(n - i) if a[-1 - k] != b[-1 - k]), n - i)
    return i + j


def _votes(rows) -> object:
    import pyarrow as pa

    cols = list(zip(*rows)) or [(), (), (), ()]
    types = (pa.string(), pa.string(), pa.string(), pa.bool_())
    return pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)], names=["wrong", "right", "piece", "sure"])


VOTES = "wrong string, right string, piece string, sure boolean"


def _learn(packed: bytes):
    """Votes of near-twins: (unusual piece, usual piece)."""

    def run(batches: Iterator) -> Iterator:
        usual = Usual(packed)
        known = lru_cache(100_000)(transformations)
        better = lru_cache(100_000)(lambda s: float(_score(usual, f" {s} ").sum()))
        clean = lru_cache(100_000)(lambda s: not any(x.odd for x in unusual_lines([s], usual)))
        for b in batches:
            got = set()
            for odd, plain in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                d = align(odd, plain)
                if d is None or d[0] == d[1] or not clean(plain):
                    continue
                for wrong, right in known(*d):
                    gain = better(plain) - better(odd)
                    if gain >= GAIN_UTF8:
                        got.add((wrong, right, odd, right == "utf_8" or gain >= GAIN_ALONE))
            yield _votes(got)

    return run


@lru_cache(None)
def _charmap(codec: str):
    return {ord(c): b[0] for c, b in _table(codec).items()}


@lru_cache(None)
def _stretch(codec: str) -> re.Pattern:
    """Runs that a codec can have given: its characters beyond ASCII with at most three of ASCII between them."""
    high = "".join(re.escape(c) for c in _table(codec) if ord(c) > 127)
    return re.compile(f"[{high}](?:[ -~]{{0,3}}[{high}])+")


_RUN = re.compile("[^\x00-\x7f](?:[ -~]{0,3}[^\x00-\x7f])*")
_WIDE = re.compile("[^\x00-\x7f](?:[ -~]{0,3}[^\x00-\x7f])+")


def strict_trials(line: str, spans, usual: Usual) -> Iterator[tuple[str, str, float]]:
    """(wrong, right, gain) of the transformations under which a stretch at ``spans`` is valid throughout and far more usual."""
    gains: dict[tuple, list] = {}
    tried: dict[tuple, float] = {}  # codecs that give the same bytes are scored once
    known: dict[tuple, float] = {}
    for wrong in SINGLE + MULTI:
        for m in (_stretch(wrong) if wrong in SINGLE else _WIDE).finditer(line):
            if not any(a < m.end() and e > m.start() for a, e in spans):
                continue
            old = m[0]
            try:
                raw = codecs.charmap_encode(old, "strict", _charmap(wrong))[0] if wrong in SINGLE else old.encode(wrong)
            except UnicodeEncodeError:
                continue
            for right in MULTI + SINGLE:
                if right == wrong:
                    continue
                gain = tried.get((m.start(), raw, right))
                if gain is None:
                    gain = tried[m.start(), raw, right] = _strict_gain(line, m.start(), m.end(), raw, right, usual, known)
                if gain >= (GAIN if right == "utf_8" else GAIN_ALONE):
                    gains.setdefault((wrong, right), []).append((gain, *m.span()))
    taken: list[tuple[int, int]] = []
    # the one that gains most on the line, then what gains most beside it; equal ones in the order of the codecs
    while gains:
        t = max(gains, key=lambda t: round(sum(g for g, _, _ in gains[t]), 6))
        got = gains.pop(t)
        yield (*t, sum(g for g, _, _ in got))
        taken += [(a, e) for _, a, e in got]
        left = {k: [x for x in v if not any(a < x[2] and e > x[1] for a, e in taken)] for k, v in gains.items()}
        gains = {k: v for k, v in left.items() if v}


def _strict_gain(line: str, start: int, end: int, raw: bytes, right: str, usual: Usual, known: dict[tuple, float]) -> float:
    try:
        new = raw.decode(right)
    except UnicodeDecodeError:
        if right not in MULTI[1:4] or not line[end : end + 1].isascii():
            return 0.0
        try:  # the last byte may be one of ASCII
            raw, end = raw + line[end : end + 1].encode(), end + 1
            new = raw.decode(right)
        except UnicodeDecodeError:
            return 0.0
    if right == "utf_8" and (below := _still_garbled(new)):
        new = below
    if _SENSELESS.search(new) or right in SINGLE and not _one_alphabet(new):
        return 0.0
    if (start, end, new) not in known:
        a, b = line[start - 1] if start else " ", line[end] if end < len(line) else " "
        if (start, end) not in known:
            known[start, end] = float(_score(usual, a + line[start:end] + b).sum())
        after = _score(usual, a + new + b)
        known[start, end, new] = float(after.sum()) - known[start, end] if (after > UNUSUAL).mean() >= 0.5 else 0.0
    return known[start, end, new]


# What restored text doesn't hold.
_SENSELESS = re.compile("[\x80-\x9f\ufffd\ue000-\uf8ff\u2500-\u259f\uff61-\uff9f]")
_ALPHABETS = [re.compile(f"[ -~\xa0¡¿«»°“”„’‘–—…№{letters}]*") for letters in ("À-ÖØ-öø-ž", "Ѐ-џ", "Ά-ώ")]
_CAPITAL_INSIDE = re.compile("[a-zß-öø-ÿа-џά-ώ][A-ZÀ-ÖØ-ÞЀ-ЯΑ-Ϋ]")


def _one_alphabet(s: str) -> bool:
    """Letters beyond ASCII of one alphabet, and no capital after a small letter."""
    return not _CAPITAL_INSIDE.search(s) and any(p.fullmatch(s) for p in _ALPHABETS)


def _learn_alone(packed: bytes, learned: list[tuple[str, str]]):
    """Votes of stretches that what is learned doesn't explain; what such a stretch teaches explains those after it."""

    def run(batches: Iterator) -> Iterator:
        known = Repairer(packed, list(learned))
        for b in batches:
            texts = b.column(0).to_pylist()
            rows = set()
            lo, size = 0, 8
            while lo < len(texts):
                part = texts[lo : lo + size]
                lo, size = lo + size, min(2 * size, 512)
                explained = known.found([t.replace(LOST, "") for t in part])
                for x in unusual_lines([t for t, e in zip(part, explained) if not e], known.usual):
                    for wrong, right, _ in strict_trials(x.text, x.spans, known.usual):
                        rows.add((wrong, right, x.text, True))
                        if (wrong, right) not in known.learned:
                            known.learned.append((wrong, right))
            yield _votes(rows)

    return run


def cover(found: list[tuple[str, str, int, set]]) -> list[tuple[str, str]]:
    """Transformations by support, without those whose pieces others explain already."""
    kept, seen = [], set()
    for wrong, right, n, some in sorted(found, key=lambda x: (-x[2], x[1] != "utf_8", x[0], x[1])):
        if some - seen:
            kept.append((wrong, right))
            seen |= some
    return kept


def _covering(votes: DataFrame) -> list[tuple[str, str]]:
    """One piece is enough where its stretch is valid and far more usual, two distinct ones elsewhere. All pieces count; what
    reaches the driver are the sets of transformations that have a piece in common, once each and without the pieces."""
    votes = votes.groupBy("wrong", "right", "piece").agg(F.max("sure").alias("sure"))
    told = votes.groupBy("wrong", "right").agg(F.count("*").alias("n"), F.max("sure").alias("sure")).where("sure OR n > 1").select("wrong", "right", "n")
    shared_by = votes.join(F.broadcast(told), ["wrong", "right"]).groupBy("piece").agg(F.array_sort(F.collect_set(F.struct("wrong", "right"))).alias("by")).select("by").distinct()
    pieces: dict[tuple, set] = {}
    for i, r in enumerate(shared_by.collect()):
        for t in r["by"]:
            pieces.setdefault((t["wrong"], t["right"]), set()).add(i)
    return cover([(r["wrong"], r["right"], r["n"], pieces[r["wrong"], r["right"]]) for r in told.collect()])


def usual_pairs(texts: DataFrame) -> bytes:
    """The packed slot table: SLOTS numbers, whatever the size of the data."""
    import numpy as np
    import zstandard

    got = texts.mapInArrow(_count_pairs, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(SLOTS, "f4")
    table[got["slot"].to_numpy()] = got["n"].to_numpy()
    return zstandard.ZstdCompressor(level=3).compress(table.tobytes())


def learn(df: DataFrame, text: str) -> tuple[bytes, list[tuple[str, str]]]:
    """The usual-pairs table and the learned transformations by support."""
    import numpy as np
    import zstandard

    texts = df.select(F.col(text).cast("string").alias("t")).where("length(t) > 0")
    packed = usual_pairs(texts)
    odd = shared.materialise(texts.mapInArrow(_suspects(packed), "kind string, piece string, key string").distinct(), "p10-suspects")
    pieces = odd.where("kind = 'f'").select("key", F.col("piece").alias("suspect"))
    slots = pieces.select("key").distinct().mapInArrow(_slots_of, "slot int").distinct().toArrow()["slot"].to_numpy()
    bits = np.zeros(KEY_BITS, "u1")
    bits[slots] = 1
    packed_bits = zstandard.ZstdCompressor(level=3).compress(np.packbits(bits).tobytes())
    plain = texts.mapInArrow(_clean(packed_bits), "key string, piece string").distinct()
    twins = pieces.join(plain, "key").where("suspect <> piece").select("suspect", "piece")
    votes = shared.materialise(twins.mapInArrow(_learn(packed), VOTES).distinct(), "p10-votes")
    learned = _covering(votes)
    # a sixteenth of the stretches first: what it teaches explains most of the others, which then need few trials
    tasks = df.sparkSession.sparkContext.defaultParallelism  # small rows, much work on each
    stretches = odd.where("kind = 's'").select("piece")
    first = F.pmod(F.xxhash64("piece"), F.lit(16)) == 0
    for part in (stretches.where(first), stretches.where(~first)):
        alone = part.repartition(tasks, "piece").sortWithinPartitions("piece").mapInArrow(_learn_alone(packed, learned), VOTES)
        votes = shared.materialise(votes.unionByName(alone), "p10-votes")
        learned = _covering(votes)
    return packed, learned


def _slots_of(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for b in batches:
        yield pa.record_batch([pa.array([_key_slot(k) for k in b.column(0).to_pylist()], pa.int32())], names=["slot"])


# ---------------------------------------------------------------- lost characters


_LOST_WORD = re.compile(rf"[^\s{LOST}]*{LOST}\S*")


def _bare(word: str) -> str:
    return re.sub(r"[^\x21-\x7e]+", "", word)


def _words(batches: Iterator) -> Iterator:
    """(bare, word, lost): words with lost characters, and whole ones with non-ASCII characters."""
    import pyarrow as pa

    for b in batches:
        out: set[tuple] = set()
        for t in b.column(0).to_pylist():
            if t and not t.isascii():
                for w in set(re.findall(r"\S*[^\x00-\x7f]\S*", t)):
                    bare = _bare(w)
                    if len(bare) > 1 and bare[0].isalpha() and len(w) <= 40:
                        out.add((bare, w, LOST in w))
        cols = list(zip(*out)) or [(), (), ()]
        yield pa.record_batch([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.bool_())], names=["bare", "word", "lost"])


def _filled(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """``rows`` with each word that holds lost characters replaced by the most frequent whole word that fits it."""
    words = texts.mapInArrow(_words, "bare string, word string, lost boolean").groupBy("bare", "word", "lost").agg(F.count("*").alias("n"))
    words = shared.materialise(words, "p10-words")
    shape = F.concat(F.lit(r"\Q"), F.replace("word", F.lit(LOST), F.lit(r"\E[^\x00-\x7f]{1,2}\Q")), F.lit(r"\E"))
    lost = words.where("lost").select("bare", F.col("word").alias("broken"), F.concat(F.lit("^"), shape, F.lit("$")).alias("shape"))
    fits = lost.join(words.where("NOT lost"), "bare").where(F.expr("word RLIKE shape"))
    best = fits.groupBy("broken").agg(F.max_by("word", F.struct("n", "word")).alias("whole"))
    broken = rows.select("row", F.explode(F.array_distinct(F.expr(rf"regexp_extract_all(restored, '[^\\s{LOST}]*{LOST}\\S*', 0)"))).alias("broken"))
    fillings = broken.join(best, "broken").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("broken", "whole"))).alias("fill"))

    def fill(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            new = []
            for t, f in zip(b.column(1).to_pylist(), b.column(3).to_pylist()):
                f = dict(f or ())
                new.append(_LOST_WORD.sub(lambda m: f.get(m[0], m[0]), t) if f else t)
            yield pa.record_batch([b.column(0), pa.array(new, pa.string()), b.column(2)], names=["doc_id", "restored", "used"])

    return rows.join(fillings, "row", "left").select("doc_id", "restored", "used", "fill").mapInArrow(fill, SHAPE)


SHAPE = "doc_id long, restored string, used array<string>"


# ---------------------------------------------------------------- operators


def found(df: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id): the records with at least one garbled stretch, as in ``repaired``, which finds the same records; each
    record is left at the first stretch that a transformation explains."""
    packed, learned = learn(df, text)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        repair = Repairer(packed, learned)
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo in range(0, len(ids), 2000):
                hit = repair.found(texts[lo : lo + 2000])
                yield pa.record_batch([pa.array([k for k, h in zip(ids[lo : lo + 2000], hit) if h], pa.int64())], names=["doc_id"])

    return _source(df, key, text).mapInArrow(run, "doc_id long")


def repaired(df: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, restored, used): the records with at least one garbled stretch, their text with the stretches taken back
    where possible, and the transformations in the order of use (``right>wrong``; ``lost`` for lost characters, which are
    reported whether they can be filled or not).

    A null, empty or ASCII text is never garbled. Repeated rows come out again. Only the two named columns are read; an
    empty table gives none.
    """
    packed, learned = learn(df, text)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        repair = Repairer(packed, learned)
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo in range(0, len(ids), 2000):
                part = texts[lo : lo + 2000]
                hit = [i for i, h in enumerate(repair.found(part)) if h]
                got = repair.restored([part[i] for i in hit])
                yield pa.record_batch([pa.array([ids[lo + i] for i in hit], pa.int64()), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.list_(pa.string()))], names=["doc_id", "restored", "used"])

    src = _source(df, key, text)
    rows = shared.materialise(src.mapInArrow(run, SHAPE).withColumn("row", F.monotonically_increasing_id()), "p10-rows")
    return _filled(rows, src.select("t"))


def _source(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t")).where("length(t) > 0")
