"""Repairing text from scanned pages (problem 5).

Passes over the latest text of each id. The first counts the words of the running text, without
page furniture and without the halves of broken words. Words above a share of all words are the
known ones; there can't be more than one over that share, which bounds what is broadcast.
The second counts the words beside each known word, and skip-gram vectors with negative
sampling are learned from those counts. Rarer words that a plausible glyph edit leads to a
known one get a vector too, fitted to the words beside them: they are linked to the known
words it is near to, and are words of their own if it is near to none. A known word is linked
to a far more frequent one in the same way. Words too rare for a vector are linked by the
glyph edit alone, and of several candidates the one that fits the words beside it best is
taken. The last pass reports, or repairs, the lines.

All thresholds are shares, but for the counts that a share of a small corpus would fall under,
so a corpus that is repeated under other ids is read as before.

Odd input: null and empty texts have no lines to report; repeated rows count once; of
several texts of an id the latest counts; a null file name gives no running headers but
those of nobody; texts and lines of any length are read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import names
from quillspark.llm.names import fold
from quillspark.session import written

#: Share of all words, and count at least, that makes a word known: at most 200 000 words.
KNOWN_SHARE, KNOWN_LEAST = 5e-6, 5
#: Words with vectors, words that count as context, words on either side, and numbers in a vector.
VECTORS, CONTEXT, WINDOW, SIZE = 8192, 256, 2, 24
#: A word is a slip of another that is this many times as frequent; if it is known, vectors must be this close.
RATIO, KNOWN_RATIO, COSINE = 3, 30, 0.5
#: Share of all words, and count at least, that gives a rarer word a vector: at most 1 000 000 words, of which those with an edit to a known one are broadcast.
RARE_SHARE, RARE_LEAST = 1e-6, 6
#: A rare word that goes with the company of none of the words it may be misread from by more than this is a word of its own.
RARE_FIT = 0.0
#: What is seen and what was printed.
GLYPHS = (
    ("c", "e"), ("e", "c"), ("f", "t"), ("t", "f"), ("b", "h"), ("h", "b"), ("u", "n"), ("n", "u"), ("1", "l"), ("1", "i"), ("0", "o"), ("5", "s"), ("6", "b"), ("8", "b"), ("9", "g"),
    ("cl", "d"), ("d", "cl"), ("rn", "m"), ("m", "rn"), ("ni", "m"), ("in", "m"), ("nn", "m"), ("vv", "w"), ("ii", "u"), ("ii", "n"), ("ii", "ü"), ("li", "h"), ("lc", "k"), ("f", "s"), ("l", "i"), ("i", "l"), ("l", "t"), ("q", "g"),
    ("í", "i"), ("ì", "i"), ("î", "i"), ("ï", "i"), ("é", "e"), ("è", "e"), ("ê", "e"), ("á", "a"), ("à", "a"), ("â", "a"), ("ó", "o"), ("ò", "o"), ("ô", "o"), ("ú", "u"), ("ù", "u"), ("ti", "n"), ("tl", "d"), ("c", "o"), ("o", "c"), ("s", "f"), ("h", "li"), ("ß", "b"), ("b", "ß"), ("fs", "ß"), ("j", "i"), ("y", "v"), ("v", "y"),
)
#: Old and joined letters.
OLD = {"ſ": "s", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "ꝛ": "r", "æ": "ae", "œ": "oe", "Æ": "Ae", "Œ": "Oe"}
_OLD = str.maketrans(OLD)
_IS_OLD = re.compile("[" + "".join(OLD) + "]")
WORD = re.compile(r"[^\W_]+")
#: Marks of a broken word at the end of a line.
MARKS = "-¬⸗\xad=‐"
_LOWER = re.compile(r"(?<![^\W_])[^\W\d_A-ZÄÖÜ][^\W_]{3,}")
#: Words before which a hyphen may stand for what the next compound ends with.
AND = frozenset("and or und oder sowie bis et ou y o e to nor noch".split())
NUMBER_LINE = re.compile(r"\s*(?:[-–—(\[*~.•·]*\s*)(?:(?:p|pp|pag|page|s|seite|fol|bl|blatt|5(?=\.\s))\.?\s*)?(?:[\dlIOoSB|]{0,4}\d[\dlIOoSB|]{0,3}|[ivxlcdm1\d]*[ivxlcdm][ivxlcdm1\d]*)(?:\s*[-–—)\]*~.•·]*)\s*$", re.IGNORECASE)
SHEET_LINE = re.compile(r"\s*(?:[A-Za-z]{1,2}\s?[\dlIO]{1,2}|[A-Za-z]{1,2}\s+[ivx]{1,4}|\*{1,2}[A-Za-z]?\s?\d{1,2}|\d{1,2}\s?\*{1,2})\.?\s*$")
CHAPTER = re.compile(r"\s*(?:[IVXLC]+\.?|(?:chapter|kapitel|book|buch|part|teil|theil|volume|band)\b.*)\s*$", re.IGNORECASE)


def _is_number(line: str) -> bool:
    s = line.strip()
    if len(s) > 16 or not s:
        return False
    if not NUMBER_LINE.fullmatch(s):
        return False
    letters = re.sub(r"^\W*(?:p|pp|pag|page|s|seite|fol|bl|blatt)\.\s*", "", s, flags=re.IGNORECASE)
    core = re.sub(r"[\W_]", "", letters)
    if any(c.isdigit() for c in core):
        return len(core) <= 3 or not core.isdigit() or core[0] != "1" or s[0] in "-–—([" or len(core) != 4
    return core.islower() and not s.endswith(".") and bool(re.fullmatch(r"m{0,3}(?:c[md]|d?c{0,4})(?:x[cl]|l?x{0,4})(?:i[xv]|v?i{0,4})", core))


def _header(line: str, tokens: frozenset[str], letters: frozenset[str]) -> bool:
    """All its words are of the title or the author, at most misread, in capitals at their start, with or without a number.

    One other word in capitals at its start may stand for a given name in another form.
    """
    words = [w for w in WORD.findall(line) if not w.isdigit()]
    if not 0 < len(words) <= 14 or len(line.strip()) > 90:
        return False
    good = other = 0
    numbered = bool(re.match(r"\s*\d{1,3}\s{2,}|.*\s{2,}\d{1,3}\s*$", line))
    for w in words:
        f = fold(w)
        if not f or any(c.isdigit() for c in f) and len(f) <= 4:
            continue
        if len(f) >= 4 and w[0].islower() and not numbered and f not in ("lady", "dame"):
            if f not in tokens or not any(x.isupper() for x in line):
                return False
        if f in tokens or len(f) >= 5 and any(abs(len(t) - len(f)) <= 2 and names.close(f, t, 0.7) for t in tokens):
            good += len(f) >= 3 or len(words) <= 2
        elif len(f) == 1 and f in letters or len(f) < 4 and f in names.PARTICLES or f in names.TITLES or f in ("by", "von"):
            continue
        elif len(f) >= 2 and any(names.is_short_of(f, t) or names.is_short_of(t, f) for t in tokens):
            continue
        elif f in names.NOBODY or f in names.SMALL:
            good += f in names.NOBODY
        elif w[0].isupper() and numbered:
            continue
        elif w[0].isupper() and len(f) >= 3 and not other:
            other = 1
        else:
            return False
    return good > other if len(words) > 2 else good > 0


def _broken(end: str) -> bool:
    return len(end) > 1 and end[-1] in MARKS and end[-2].isalpha()


class Page:
    """The lines of a text, which are furniture, and the words of the others."""

    def __init__(self, text: str, file_name: str | None):
        self.lines = text.split("\n")
        parts = re.split(r"[_\-\s]+", file_name or "")
        tokens = frozenset(t for p in parts for x in WORD.findall(p) if (t := fold(x)) and not t.isdigit())
        letters = frozenset(t[0] for t in tokens)
        exact = {w.lower() for p in parts for w in WORD.findall(p) if len(w) > 2} | names.NOBODY
        self.drop: set[int] = set()
        self.at: list[int] = []
        self.words: list[list[str]] = []
        self.gap: list[bool] = []
        seen: dict[str, bool] = {}
        self.ends: list[str] = []
        blank = True
        find = WORD.findall
        for i, line in enumerate(self.lines):
            words = find(line)
            if not words:
                blank = blank or not line.strip()
                continue
            n = len(words)
            if n <= 3 and len(line) <= 40 and (_is_number(line) or SHEET_LINE.fullmatch(line)) and not (words[0].isupper() and CHAPTER.fullmatch(line)):
                self.drop.add(i)
                continue
            end = line.rstrip()
            # a header has no longer word in lower case but those of the title, unless it has a number at an end
            if n <= 14 and len(line) <= 120 and (words[0].isdigit() or words[-1].isdigit() or not (m := _LOWER.search(line)) or m.group() in exact):
                key = line.strip()
                hit = seen.get(key)
                if hit is None:
                    near = any(w.lower() in exact for w in words) or n <= 9 and (line.isupper() or all(w[0].isupper() or w.isdigit() for w in words))
                    hit = seen[key] = near and not CHAPTER.fullmatch(line) and _header(line, tokens, letters) and not _broken(end)
                if hit and self._furniture(i, line):
                    self.drop.add(i)
                    continue
            self.at.append(i)
            self.words.append(words)
            self.gap.append(blank)
            self.ends.append(end)
            blank = False

    def _furniture(self, i: int, line: str) -> bool:
        """A line of the title's words in running prose ends a sentence that the line before began."""
        if line.isupper() or any(c.isdigit() for c in line) or "," in line or line.startswith("\f"):
            return True
        words = WORD.findall(line)
        return len(words) > 1 and sum(w[0].isupper() for w in words) >= 0.6 * len(words)

    def breaks(self) -> Iterator[tuple[int, bool, bool]]:
        """(number among the lines with words, marked, elliptic) of the lines that may end inside a word."""
        words, gap = self.words, self.gap
        for k, end in enumerate(self.ends[:-1]):
            last = end[-1]
            if last in MARKS:
                if _broken(end):
                    yield k, True, words[k + 1][0].lower() in AND
            elif not gap[k + 1] and last.isalnum() and words[k + 1][0][0].islower():
                yield k, False, False

    def first_words(self) -> list[str]:
        """The words in order, without the halves of marked breaks."""
        cut = {k for k, marked, elliptic in self.breaks() if marked and not elliptic}
        out: list[str] = []
        for k, w in enumerate(self.words):
            out += w[(1 if k - 1 in cut else 0) : (len(w) - 1 if k in cut else len(w))]
        return out


BLOCK = "words array<string>, n array<long>, capital array<long>, seq binary"
#: Between texts in the sequence of a block.
_STOP = 0xFFFFFFFF


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a batch of texts: its distinct words in lower case, how often each stands and with a capital, and the words in order."""
    schema = pa.schema([("words", pa.list_(pa.string())), ("n", pa.list_(pa.int64())), ("capital", pa.list_(pa.int64())), ("seq", pa.binary())])
    for b in batches:
        index: dict[str, int] = {}
        seq: list[int] = []
        for name, text in zip(b.column("file_name").to_pylist(), b.column("text").to_pylist()):
            seq += [index.setdefault(w, len(index)) for w in Page(text, name).first_words()]
            seq.append(_STOP)
        # words that differ in case alone become one
        low: dict[str, int] = {}
        to = np.array([low.setdefault(w.lower(), len(low)) for w in index] or [0], dtype=np.int64)
        upper = np.array([w[0].isupper() for w in index] or [False])
        at = np.array(seq, dtype=np.int64)
        some = at != _STOP
        count = np.bincount(at[some], minlength=max(1, len(index)))
        n, capital = np.bincount(to, weights=count, minlength=len(low)), np.bincount(to, weights=count * upper, minlength=len(low))
        at[some] = to[at[some]]
        yield pa.RecordBatch.from_pydict({"words": [list(low)], "n": [n.astype(np.int64)[: len(low)]], "capital": [capital.astype(np.int64)[: len(low)]], "seq": [at.astype(np.uint32).tobytes()]}, schema=schema)


def _beside(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        total = np.zeros(VECTORS * CONTEXT, dtype=np.int64)
        for b in batches:
            for words, seq in zip(b.column("words").to_pylist(), b.column("seq").to_pylist()):
                to = np.array([index.get(w, -1) for w in words] + [-1], dtype=np.int64)
                at = np.frombuffer(seq, dtype=np.uint32).astype(np.int64)
                a = to[np.where(at == _STOP, len(words), at)]
                for o in range(1, WINDOW + 1):
                    for w, c in ((a[:-o], a[o:]), (a[o:], a[:-o])):
                        ok = (w >= 0) & (c >= 0) & (c < CONTEXT)
                        total += np.bincount(w[ok] * CONTEXT + c[ok], minlength=VECTORS * CONTEXT)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["pair", "n"])

    return run


def skip_gram(counts: np.ndarray, rounds: int = 60, negative: int = 5, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Word and context vectors by gradient steps on the skip-gram objective with negative sampling.

    counts holds how often each word (row) has each context (column); all pairs take part in every step,
    each with its expected number of negative samples, so the result has no sampling noise.
    """
    rng = np.random.default_rng(seed)
    n, m = counts.shape
    v, u = rng.normal(0, 0.1, (n, SIZE)).astype(np.float32), rng.normal(0, 0.1, (m, SIZE)).astype(np.float32)
    pos = counts.astype(np.float32)
    noise = pos.sum(axis=0) ** 0.75
    noise /= max(noise.sum(), 1e-9)
    neg = negative * pos.sum(axis=1, keepdims=True) * noise[None, :]
    scale = 1.0 / np.maximum(pos.sum(axis=1, keepdims=True), 1.0)
    pos, neg = pos * scale, neg * scale
    gv, gu = np.full_like(v, 1e-6), np.full_like(u, 1e-6)
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(v @ u.T, -30, 30)))
        g = pos * (1 - p) - neg * p
        dv, du = g @ u, g.T @ v
        gv += dv**2
        gu += du**2
        v += 0.3 * dv / np.sqrt(gv)
        u += 0.3 * du / np.sqrt(gu)
    return v, u


def edits(word: str) -> set[str]:
    """What one glyph edit makes of a word."""
    out = set()
    for a, b in GLYPHS:
        i = word.find(a)
        while i >= 0:
            out.add(word[:i] + b + word[i + len(a) :])
            i = word.find(a, i + 1)
    out.discard(word)
    return out


class Speller:
    """Links words to the known words they are misread from."""

    def __init__(self, words: list[str], n: np.ndarray, capital: np.ndarray, v: np.ndarray, u: np.ndarray, own: frozenset[str] = frozenset(), least: float = 0.0):
        self.index = {w: i for i, w in enumerate(words)}
        self.words, self.n, self.capital, self.v, self.u = words, n, capital, v, u
        self.unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9) if len(v) else v
        # what a word is corrected to is more frequent than a rare word can be; small corpora need a count
        self.least = max(least, RATIO * min(KNOWN_LEAST, least or KNOWN_LEAST))
        self.memo: dict[str, list[int]] = {}
        self.slips: dict[str, list[int]] = {}
        for w, i in self.index.items():
            if len(w) < 3:
                continue
            to = [j for x in edits(w) if (j := self.index.get(x)) is not None and n[j] >= KNOWN_RATIO * n[i]]
            to = [j for j in to if i < len(v) and j < len(v) and float(self.unit[i] @ self.unit[j]) >= COSINE]
            if to:
                self.slips[w] = to

        self.good = {w for w in self.index if w not in self.slips and not _IS_OLD.search(w)}
        self.own = own

    def known(self, w: str) -> bool:
        return w in self.good

    def candidates(self, w: str) -> list[int]:
        """Numbers of the known words that one glyph edit, or in long words two, leads to."""
        if w in self.slips:
            return self.slips[w]
        if w in self.index or w in self.own or len(w) < 2 or w.isdigit():
            return []
        if len(self.memo) > 200_000:
            self.memo.clear()
        got = self.memo.get(w)
        if got is None:
            one = edits(w)
            got = [self.index[x] for x in one if self.known(x) and self.n[self.index[x]] >= self.least]
            if not got and len(w) >= 6:
                got = [self.index[x] for y in one for x in edits(y) if self.known(x) and self.n[self.index[x]] >= self.least]
            if len(w) < 3:
                got = [i for i in got if not w.isalpha()]
            got = self.memo[w] = list(dict.fromkeys(got))
        return got

    def correct(self, word: str, start: bool, beside: list[str]) -> str | None:
        """The word that is meant, or null if the word is no misread ordinary word."""
        w = word.lower()
        plain = w.translate(_OLD)
        if plain != w:
            return plain
        found = self.candidates(w)
        if not found:
            return None
        upper = word[0].isupper()
        share = self.capital / self.n
        found = [i for i in found if start and upper or (share[i] >= 0.5 if upper else share[i] < 0.9 or not word[0].isalpha())]
        if not found:
            return None
        if len(found) > 1:
            near = [self.index[x.lower()] for x in beside if x.lower() in self.index]
            near = [i for i in near if i < len(self.u)]

            def fit(i: int) -> float:
                p = float(np.log(self.n[i]))
                return p + (float((self.u[near] @ self.v[i]).sum()) if i < len(self.v) and near else 0.0)

            found.sort(key=lambda i: (-fit(i), i))
        return self.words[found[0]]


def joins(page: Page, sp: Speller) -> dict[int, tuple[str, bool]]:
    """Number of the line that ends inside a word, with the whole word and whether it is a compound with a hyphen."""
    own: Counter | None = None
    out = {}
    for k, marked, elliptic in page.breaks():
        a, b = page.words[k][-1], page.words[k + 1][0]
        if not marked and a.lower() in sp.good and b.lower() in sp.good:
            continue
        whole = (a + b).lower()
        if marked:
            if elliptic and not sp.known(whole):
                continue
            compound = "-" in page.lines[page.at[k]][-3:] and not sp.known(whole) and sp.known(a.lower()) and sp.known(b.lower())
            out[k] = (a + b, compound)
        elif not (sp.known(a.lower()) and sp.known(b.lower())) and len(whole) > 3:
            if own is None:
                own = Counter(w.lower() for ws in page.words for w in ws)
            if sp.known(whole) or own[whole] > 0 or (sp.candidates(whole) and not sp.candidates(a.lower()) and not sp.known(b.lower())):
                if not (sp.candidates(a.lower()) and sp.known(b.lower())) or sp.known(whole):
                    out[k] = (a + b, False)
    return out


def _differs(seen: str, meant: str) -> int:
    """Where the first difference is."""
    return next((i for i, (x, y) in enumerate(zip(seen.lower(), meant)) if x != y), min(len(seen), len(meant)) - 1)


def inspect(text: str, file_name: str | None, sp: Speller) -> tuple[Page, dict[int, tuple[str, bool]], dict[tuple[int, int], str]]:
    """The page, its joins and its corrections (line with words, word) to the word meant; of a joined word at its first half."""
    page = Page(text, file_name)
    joined = joins(page, sp)
    fixes: dict[tuple[int, int], str] = {}
    for k, words in enumerate(page.words):
        lows = [w.lower() for w in words]
        if sp.good.issuperset(lows):
            continue
        line = page.lines[page.at[k]]
        start = k == 0 or any(c in ".!?…" for c in page.ends[k - 1][-2:])
        for j, w in enumerate(words):
            first = j == 0 and (start or page.gap[k])
            if lows[j] in sp.good:
                continue
            half = None
            if j == len(words) - 1 and k in joined:
                half = k
            elif j == 0 and k - 1 in joined:
                continue
            whole = joined[half][0] if half is not None else w
            if half is not None and sp.known(whole.lower()):
                continue
            pos = line.find(w)
            before = line[:pos].rstrip(" \"“„»«‘'(—–")[-1:] if pos >= 0 else ""
            begins = first or j > 0 and before in ".!?…:" or pos > 0 and line[pos - 1] in "“„»«\"‘"
            beside = words[max(0, j - WINDOW) : j] + words[j + 1 : j + 1 + WINDOW]
            if half is not None and joined[half][1]:
                meant = sp.correct(w, begins, beside)
                if meant:
                    fixes[(k, j)] = meant
                continue
            meant = sp.correct(whole, begins, beside)
            if meant:
                if half is not None and _differs(whole, meant) >= len(w):
                    fixes[(k + 1, 0)] = meant
                else:
                    fixes[(k, j)] = meant
            elif half is not None:
                for key, part in (((k, j), w), ((k + 1, 0), page.words[k + 1][0])):
                    if not sp.known(part.lower()) and len(part) > 3 and (m := sp.correct(part, False, beside)):
                        fixes[key] = m
    return page, joined, fixes


def _report(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = Speller(*shared.value)
        for b in batches:
            ids, lines, kinds = [], [], []
            for key, name, text in zip(b.column(0).to_pylist(), b.column("file_name").to_pylist(), b.column("text").to_pylist()):
                page, joined, fixes = inspect(text, name, sp)
                rows = [(i, "drop") for i in page.drop] + [(page.at[k], "join") for k in joined] + [(page.at[k], "glyph") for k in {k for k, _ in fixes}]
                ids += [key] * len(rows)
                lines += [r[0] for r in rows]
                kinds += [r[1] for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(ids, type=b.schema.field(0).type), pa.array(lines, type=pa.int32()), pa.array(kinds, type=pa.string())], [b.schema.field(0).name, "line_no", "kind"])

    return run


def _like(word: str, meant: str) -> str:
    return meant.upper() if word.isupper() and len(word) > 1 else meant[0].upper() + meant[1:] if word[0].isupper() else meant


def repair(text: str, file_name: str | None, sp: Speller) -> str:
    """Paragraphs of continuous text: without furniture, with whole and corrected words; a blank line between paragraphs."""
    page, joined, fixes = inspect(text, file_name, sp)
    paragraphs: list[str] = []
    glue = ""
    indents = Counter(len(page.lines[i]) - len(page.lines[i].lstrip()) for i in page.at)
    usual = indents.most_common(1)[0][0] if indents else 0
    for k, i in enumerate(page.at):
        line = page.lines[i]
        for j in range(len(page.words[k]) - 1, -1, -1):
            if (k, j) in fixes and not (k in joined and j == len(page.words[k]) - 1) and not (k - 1 in joined and j == 0):
                spans = [m.span() for m in WORD.finditer(line)]
                a, z = spans[j]
                line = line[:a] + _like(line[a:z], fixes[(k, j)]) + line[z:]
        body = line.strip()
        if k - 1 in joined:
            body = body[len(page.words[k][0]) :] if body.startswith(page.words[k][0]) else body
        if k in joined:
            whole, compound = joined[k]
            last = page.words[k][-1]
            cut = body.rfind(last)
            meant = fixes.get((k, len(page.words[k]) - 1)) or fixes.get((k + 1, 0))
            word = f"{last}-{page.words[k + 1][0]}" if compound else _like(whole, meant) if meant else whole
            body = body[:cut] + word
        fresh = not paragraphs or (page.gap[k] or len(page.lines[i]) - len(page.lines[i].lstrip()) >= usual + 2) and k - 1 not in joined and not _goes_on(paragraphs[-1], page, k)
        if fresh:
            paragraphs.append(body)
        else:
            paragraphs[-1] += glue + body
        glue = "" if k in joined else " "
    return "\n\n".join(re.sub(r"\s+", " ", p) for p in paragraphs)


def _goes_on(so_far: str, page: Page, k: int) -> bool:
    """A gap that furniture made: the paragraph so far doesn't end a sentence and furniture lies between."""
    between = range(page.at[k - 1] + 1, page.at[k]) if k else ()
    return any(i in page.drop for i in between) and not re.search(r"[.!?…:][\"”“»«’']*$", so_far)


def _beside_rare(shared):
    """(word, context, n) of the words that are rare but may have a vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, rare = shared.value
        for b in batches:
            total: Counter = Counter()
            for words, seq in zip(b.column("words").to_pylist(), b.column("seq").to_pylist()):
                mine = [k for k, w in enumerate(words) if w in rare]
                if not mine:
                    continue
                flag = np.zeros(len(words) + 1, dtype=bool)
                flag[mine] = True
                to = np.array([index.get(w, -1) for w in words] + [-1], dtype=np.int64)
                at = np.frombuffer(seq, dtype=np.uint32).astype(np.int64)
                at = np.where(at == _STOP, len(words), at)
                for o in range(1, WINDOW + 1):
                    for x, y in ((at[:-o], at[o:]), (at[o:], at[:-o])):
                        ok = flag[x]
                        x, c = x[ok], to[y[ok]]
                        ok = (c >= 0) & (c < CONTEXT)
                        pair, n = np.unique(x[ok] * CONTEXT + c[ok], return_counts=True)
                        for p, k in zip(pair.tolist(), n.tolist()):
                            total[(words[p // CONTEXT], p % CONTEXT)] += k
            keys = list(total)
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in keys], type=pa.string()), pa.array([c for _, c in keys], type=pa.int32()), pa.array([total[k] for k in keys], type=pa.int64())], ["word", "context", "n"])

    return run


def company(counts: np.ndarray, u: np.ndarray, v: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """How well the words beside further words (rows of counts) go with the words whose vectors are v, above what chance words do.

    The vector of a further word is the mean of the context vectors beside it, less the mean of all; its product
    with v is positive in like company and negative in other company.
    """
    beside = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1.0) - noise[None, :]
    return (beside @ u) @ v.T


def _own(shared):
    """Which of the rare words (word, contexts) are words of their own: far from all the known words they may be misread from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n, capital, v, u, noise, least = shared.value
        sp = Speller(words, n, capital, v, u, least=least)
        for b in batches:
            rare, rows = b.column("word").to_pylist(), b.column("contexts").to_pylist()
            counts = np.zeros((len(rare), len(u)))
            for k, row in enumerate(rows):
                for x in row:
                    counts[k, x["context"]] = x["n"]
            keep = []
            for k, w in enumerate(rare):
                to = sp.candidates(w)
                if to and max(to) < len(v) and company(counts[k : k + 1], u, v[to], noise).max() < RARE_FIT:
                    keep.append(w)
            yield pa.RecordBatch.from_arrays([pa.array(keep, type=pa.string())], ["word"])

    return run


def _linked(shared):
    """The words that a glyph edit leads to a known one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n, capital, v, u, _, least = shared.value
        sp = Speller(words, n, capital, v, u, least=least)
        for b in batches:
            yield b.filter(pa.array([bool(sp.candidates(w)) for w in b.column(0).to_pylist()], type=pa.bool_()))

    return run


def learn(texts: DataFrame) -> tuple:
    """What a Speller needs, of all texts (text, file_name): known words with counts, vectors, and rare words of their own."""
    spark = texts.sparkSession
    sc = spark.sparkContext
    blocks = written(texts.select("text", "file_name").mapInArrow(_blocks, BLOCK))
    flat = blocks.select(F.explode(F.arrays_zip("words", "n", "capital")).alias("x"))
    counts = written(flat.groupBy(F.col("x.words").alias("word")).agg(F.sum("x.n").alias("n"), F.sum("x.capital").alias("capital")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = max(KNOWN_LEAST, KNOWN_SHARE * total)
    known = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "word").toPandas()
    words = known["word"].tolist()
    index = {w: i for i, w in enumerate(words[:VECTORS])}
    pairs = blocks.select("words", "seq").mapInArrow(_beside(sc.broadcast(index)), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((min(len(words), VECTORS), CONTEXT), dtype=np.float64)
    at = pairs["pair"].to_numpy(dtype=np.int64)
    table[at // CONTEXT, at % CONTEXT] = pairs["n"].to_numpy(dtype=np.float64)
    table = table[:, : min(len(words), CONTEXT)]
    v, u = skip_gram(table)
    noise = table.sum(axis=0) ** 0.75
    noise /= max(noise.sum(), 1e-9)
    n, capital = known["n"].to_numpy(dtype=np.float64), known["capital"].to_numpy(dtype=np.float64)
    shared = sc.broadcast((words, n, capital, v, u, noise, least))
    rare = counts.where((F.col("n") < least) & (F.col("n") >= max(RARE_LEAST, RARE_SHARE * total))).select("word").mapInArrow(_linked(shared), "word string")
    rare = frozenset(rare.toPandas()["word"])
    own: frozenset[str] = frozenset()
    if rare and len(u):
        beside = blocks.select("words", "seq").mapInArrow(_beside_rare(sc.broadcast((index, rare))), "word string, context int, n long")
        each = beside.groupBy("word", "context").agg(F.sum("n").alias("n")).groupBy("word").agg(F.collect_list(F.struct("context", "n")).alias("contexts"))
        own = frozenset(each.mapInArrow(_own(shared), "word string").toPandas()["word"])
    return words, n, capital, v, u, own, least


def current(df: DataFrame, key: str, text: str, file_name: str, order: str) -> DataFrame:
    """(key, file_name, text): the latest text of each id, as a table, since it is read more than once."""
    rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull() & (F.col(text) != ""))
    last = rows.groupBy(key).agg(F.max(F.struct(order, file_name, text)).alias("_l"))
    return written(last.select(key, F.col(f"_l.{file_name}").alias("file_name"), F.col(f"_l.{text}").alias("text")))


def found(df: DataFrame, key: str = "text_id", text: str = "text", file_name: str = "file_name", order: str = "received_at") -> DataFrame:
    """(key, line_no, kind): the lines that are furniture, end inside a word, or have a misread word."""
    now = current(df, key, text, file_name, order)
    shared = df.sparkSession.sparkContext.broadcast(learn(now))
    kind = df.schema[key].dataType.simpleString()
    return now.mapInArrow(_report(shared), f"`{key}` {kind}, line_no int, kind string")


def repaired(df: DataFrame, key: str = "text_id", text: str = "text", file_name: str = "file_name", order: str = "received_at") -> DataFrame:
    """(key, text): every text that isn't null or empty as continuous paragraphs; repeated rows give one row."""
    now = current(df, key, text, file_name, order)
    shared = df.sparkSession.sparkContext.broadcast(learn(now))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = Speller(*shared.value)
        for b in batches:
            out = [repair(t, n, sp) for t, n in zip(b.column("text").to_pylist(), b.column("file_name").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, type=pa.string())], [b.schema.field(0).name, "text"])

    kind = df.schema[key].dataType.simpleString()
    return now.mapInArrow(run, f"`{key}` {kind}, text string")
