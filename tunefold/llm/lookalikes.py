"""One consistent form for text that looks the same (problem 7).

Code points and short strings that look alike are joined by union-find into transitive classes: forms of another width,
joined letters, accents apart from their letters, odd spaces, invisible characters, and look-alike letters of other
alphabets. Each class gets, for each alphabet, a representative: among its ordinary members (composed, of ordinary width,
visible, of letters those of ordinary writing) the one most frequent in the data; of equally frequent ones the first. A multi-pattern automaton rewrites greedily, longest match first. A word that
mixes alphabets is then written in one: the one in which all its letters exist, by letter-pair frequency if two do.

Only counts of code points and of letter pairs go to the driver; both are bounded by Unicode, not by the data.
"""

from __future__ import annotations

import math
import unicodedata as U
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters that look like a Latin letter (Cyrillic, Greek, Armenian, Latin variants).
LATIN_ALIKE = {
    "a": "аα", "c": "сϲ", "d": "ԁ", "e": "еҽ", "g": "ɡց", "h": "һհ", "i": "іι", "j": "јϳ", "k": "κ", "l": "ӏ", "n": "ո", "o": "оοօ",
    "p": "рρ", "q": "ԛզ", "s": "ѕ", "u": "սυ", "v": "νѵ", "w": "ԝ", "x": "х", "y": "уγү", "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ",
    "G": "Ԍ", "H": "НΗ", "I": "ІΙӀ", "J": "ЈͿ", "K": "КΚ", "L": "Լ", "M": "МΜ", "N": "Ν", "O": "ОΟՕ", "P": "РΡ", "Q": "Ԛ", "S": "ЅՏ",
    "T": "ТΤ", "U": "Ս", "V": "Ѵ", "W": "Ԝ", "X": "ХΧ", "Y": "ҮΥУ", "Z": "Ζ",
}
SCRIPTS = ("Latin", "Cyrillic", "Greek", "Armenian")
WIDTH_TAGS = ("<wide>", "<narrow>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>")

_INVISIBLE = regex.compile(r"[\p{Cf}͏ᅟᅠ឴឵᠋-᠏ㅤ︀-️ﾠ\x00-\x08\x0e-\x1f\x7f]")
_EMOJI = regex.compile(r"[\p{Extended_Pictographic}\U0001f3fb-\U0001f3ff⃣\U0001f1e6-\U0001f1ff]")
_WORD = regex.compile(r"[\p{L}\p{M}]+")
_PER_SCRIPT = {s: regex.compile(rf"\p{{{s}}}") for s in SCRIPTS}


def script_of(ch: str) -> str | None:
    for s, p in _PER_SCRIPT.items():
        if p.match(ch):
            return s
    return None


class Classes:
    """Union-find over code points and short strings."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def groups(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = defaultdict(list)
        for x in list(self.parent):
            out[self.find(x)].append(x)
        return out


def _plain(s: str) -> bool:
    """A member that may stand for its class."""
    return U.normalize("NFC", s) == s and not any(U.decomposition(c).startswith(WIDTH_TAGS) or _joined(c) for c in s)


def _in_use(c: str) -> bool:
    """A letter of a language's ordinary writing: some eight-bit set of its alphabet has it."""
    for codec in ("cp1252", "cp1250", "cp1254", "cp1257", "cp1251", "iso8859_5", "cp1253"):
        try:
            c.encode(codec)
            return True
        except UnicodeEncodeError:
            pass
    return False


def _joined(c: str) -> bool:
    """One character made of several letters."""
    d = U.decomposition(c)
    return d.startswith("<compat>") and U.category(c)[0] == "L" and len(d.split()) > 2


def build_model(counts: dict[str, int], pairs: dict[str, int]) -> dict:
    """The rewriting table and the look-alikes per alphabet from counts of code points and of letter pairs in a word."""
    forms, letters = Classes(), Classes()
    seen = set(counts)
    for c in seen:
        if c.isspace() and U.category(c) in ("Zs", "Zl", "Zp", "Cc"):
            forms.join(c, " ")
        elif U.decomposition(c).startswith(WIDTH_TAGS) or _joined(c):
            forms.join(c, U.normalize("NFC", U.normalize("NFKC", c)))
        elif U.normalize("NFC", c) != c:
            forms.join(c, U.normalize("NFC", c))
    marks = [c for c in {x for s in seen for x in U.normalize("NFKC", s)} if U.combining(c)]
    bases = {U.normalize("NFKC", c) for c in seen} | seen
    for b in bases:
        for m in marks:
            whole = U.normalize("NFC", b + m)
            if len(b) == 1 and len(whole) == 1 and whole != b:
                forms.join(b + m, whole)
    for c, alike in LATIN_ALIKE.items():
        for x in alike:
            letters.join(c, x)
    table: dict[str, str] = {}
    for members in forms.groups().values():
        ordinary = [m for m in members if _plain(m)]
        if " " in ordinary:
            ordinary = [" "]
        if ordinary:
            best = max(ordinary, key=lambda m: (counts.get(m, 0), -len(m), m))
            table.update({m: best for m in members if m != best})
    by_script: dict[str, dict[str, str]] = {s: {} for s in SCRIPTS}
    for members in letters.groups().values():
        for s in SCRIPTS:
            own = [m for m in members if script_of(m) == s]
            if own:
                best = max(own, key=lambda m: (_in_use(m), counts.get(m, 0), -ord(m)))
                by_script[s].update({m: best for m in members})
    odd = {m: v for m, v in by_script["Latin"].items() if script_of(m) == "Latin" and m != v}
    return {"table": table, "by_script": by_script, "odd": odd, "pairs": pairs}


class Rewriter:
    """Applies a model to strings; made once per Python worker task."""

    def __init__(self, model: dict) -> None:
        import ahocorasick

        self.table, self.by_script, self.odd, self.pairs = model["table"], model["by_script"], model["odd"], model["pairs"]
        self.automaton = ahocorasick.Automaton()
        for k, v in self.table.items():
            self.automaton.add_word(k, (len(k), v))
        if self.table:
            self.automaton.make_automaton()
        self.known: dict[str, str] = {}

    def __call__(self, s: str) -> str:
        if s.isascii() and s.isprintable():
            return s
        s = self._visible(s)
        if self.table:
            out, at = [], 0
            for end, (n, v) in self.automaton.iter_long(s):
                out += [s[at : end - n + 1], v]
                at = end + 1
            s = "".join(out) + s[at:]
        s = U.normalize("NFC", s)
        return _WORD.sub(lambda m: self._word(m[0]), s)

    def _visible(self, s: str) -> str:
        if not _INVISIBLE.search(s):
            return s
        out = []
        for i, c in enumerate(s):
            if _INVISIBLE.match(c):
                before = i > 0 and (_EMOJI.match(s[i - 1]) or i > 1 and s[i - 1] in "️‍" and _EMOJI.match(s[i - 2]))
                if c == "‍":
                    keep = before and i + 1 < len(s) and _EMOJI.match(s[i + 1])
                elif c == "️":
                    keep = before or i + 1 < len(s) and s[i + 1] == "⃣"
                else:
                    keep = "\U000e0020" <= c <= "\U000e007f" and bool(out) and (before or "\U000e0020" <= out[-1] <= "\U000e007f")
                if not keep:
                    continue
            out.append(c)
        return "".join(out)

    def _word(self, w: str) -> str:
        if w.isascii():
            return w
        got = self.known.get(w)
        if got is None:
            if len(self.known) > 100_000:
                self.known.clear()
            got = self.known[w] = self._one_alphabet(w)
        return got

    def _one_alphabet(self, w: str) -> str:
        scripts = {script_of(c) for c in w} - {None}
        if len(scripts) < 2:
            return "".join(self.odd.get(c, c) for c in w) if "Latin" in scripts else w
        ways = []
        for s in scripts:
            new = [self._letter(c, s) for c in w]
            if None not in new:
                text = U.normalize("NFC", "".join(new))
                ways.append((self._fit(text), sum(a == b for a, b in zip(new, w)), s, text))
        return max(ways)[3] if ways else w

    def _letter(self, c: str, script: str) -> str | None:
        if script_of(c) in (None, script):
            return self.odd.get(c, c)
        base, marks = U.normalize("NFD", c)[0], U.normalize("NFD", c)[1:]
        base = self.by_script[script].get(base)
        return base and base + marks

    def _fit(self, w: str) -> float:
        """Mean log frequency of the word's letter pairs in the data."""
        w = f" {w.lower()} "
        return sum(math.log1p(self.pairs.get(w[i : i + 2], 0)) for i in range(len(w) - 1)) / (len(w) - 1)


def _count(batches: Iterator) -> Iterator:
    import pyarrow as pa

    total: Counter = Counter()
    for b in batches:
        texts = [t for t in b.column(0).to_pylist() if t]
        total.update("".join(texts))
        for w in _WORD.findall(" ".join(texts)):
            w = w.lower()
            if len({script_of(w[0]), script_of(w[-1])}) == 1 and script_of(w[0]):
                w = f" {w} "
                total.update(w[i : i + 2] for i in range(len(w) - 1))
    keys = list(total)
    yield pa.record_batch([pa.array(keys, pa.string()), pa.array([total[k] for k in keys], pa.int64())], names=["k", "n"])


def fit(texts: DataFrame) -> dict:
    """The model for a one-column frame of texts. Every text is counted."""
    got = texts.mapInArrow(_count, "k string, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    return build_model({r["k"]: r["n"] for r in got if len(r["k"]) == 1}, {r["k"]: r["n"] for r in got if len(r["k"]) == 2})


def consistent_form(column: Column | str, model: dict) -> Column:
    """The consistent form of a text column; null stays null, empty stays empty."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        rewrite = Rewriter(model)  # one automaton and one memory of words for all batches of a task
        for texts in batches:
            yield pd.Series([None if t is None else rewrite(t) for t in texts], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, T.StringType())(column)


def consistent(tables: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """(tbl, row_id, value, form) for (name, table, key column, text column); one model is fitted over all of them.

    Repeated rows come out again, null values with a null form; an empty table adds nothing.
    """
    parts = [df.select(F.lit(name).alias("tbl"), F.col(key).cast("long").alias("row_id"), F.col(text).alias("value")) for name, df, key, text in tables]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.withColumn("form", consistent_form("value", fit(rows.select("value"))))
