"""Text quality statistics, and telling prose from lists, tables and junk (problem 8).

statistics() gives the plain ratios of a text by built-in SQL functions. layout() adds
what needs a look at the lines as a whole, in Arrow batches: delimiters that stand in the
same number on every line or in the same column of characters, the periods at which the
indentation and the line lengths repeat and their autocorrelation there, and the shares
of the text that read as prose, as entries of a list, as rows of a table or as nothing.
found() decides.

Results for odd input: null, empty and blank texts have null statistics and are no case.
Every row in gives one row out, repeated ids included. Texts of any length are read whole;
the work is linear in the length but for the alignment, which looks at line starts only.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent function words of English, German, French and Spanish.
COMMON = frozenset(
    """the of and a an to in is was it that for on with as at by be had he she his her they not but or from this which who what than so if
    would have has were are been one there their about into up out when while though
    der die das und ein eine einen einem einer eines zu in im am den dem des von mit auf für ist war nicht als aber wenn dann was wie so nach
    bei aus doch denn noch nur man sich an dass ob hatte über unter zwischen vor
    le la les et de du des un une dans en que qui ne pas pour sur avec sans sous mais car au aux par se son sa était plus
    el los las y del una por con para al no lo su sin sobre bajo pero pues tras ante entre como más era""".split()
)

BULLET = re.compile(r"\s*(?:[-–—*•·▪◦‣○●►➤>+#~]+|\[[ xX]?\]|\(?(?:\d{1,4}|[a-zA-Z]|[ivxlcIVXLC]{1,6})[.):]|\(\w{1,3}\)|[☐☑✓✗]|№\s*\d+|Nr?o?\.\s*\d+)\s+(?=\S)")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
TAG = re.compile(r"<[a-zA-Z/!][^<>]{0,200}>|&(?:[a-zA-Z]{2,8}|#\d{1,6});|\{\{[^{}]{0,40}\}\}|\[\[|\]\]")
NUMBER = re.compile(r"^[\s\"']*[-+]?[\d.,:/%$€£]*\d[\d.,:/%$€£]*[\s\"']*$|^\s*(?:-|–|—|NA|N/A|n/a|NaN|null|\.)?\s*$")
MARKS = re.compile(r"[^\w\s.,;:!?'\"“”‘’„»«()\-–—…]")
#: Letters and signs of Latin-1 that the languages at hand hardly use.
ODD = re.compile("[\xa1-\xff](?<![äöüßÄÖÜàâáéèêëíîïóôòúûùæøåñçÀÂÁÉÈÊËÍÎÏÓÔÚÛÙÆØÅÑÇ«»¿¡§°])")
INLINE = (re.compile(r"\s*[/|;•·¦]\s+|\s+[/|•·–—-]\s+|;\s*"), re.compile(r",\s+"))
VOWELS = frozenset("aeiouyäöüàâáéèêëíîïóôòúûùæœøåAEIOUYÄÖÜÀÂÁÉÈÊËÍÎÏÓÔÒÚÛÙÆŒØÅ")
END = re.compile(r"[.!?…:;,][\"'”’“‘»«)\]]*\s*$")
GAP = re.compile(r"\S {2,}\S")
RULE = re.compile(r"[\s|¦+:=\-_–—.]*")
BREAK = re.compile(r"\r\n?|[\f\v\x85\u2028\u2029]")
STOP = re.compile(r"[.!?…][\"'”’“‘»«)\]]*\s*$")
#: Longest period in lines that is looked for.
MAX_LAG = 24
DELIMITERS = ("|", "¦", "\t", ";", ",", "/", "~", "^", "‖")


def _cells(line: str, d: str) -> list[str]:
    if d == ",":
        line = re.sub(r'"[^"]*"', lambda m: m.group().replace(",", "\x00"), line)
    line = line.strip(" \n") if d == "\t" else line.strip()
    if d in "|¦" and line.startswith(d):
        line = line[1:]
    if d in "|¦" and line.endswith(d):
        line = line[:-1]
    return line.split(d)


@lru_cache(maxsize=200_000)
def _readable(w: str) -> bool:
    """Has the vowels of a word that can be spoken; scripts without such letters pass."""
    if len(w) == 1 or ord(w[0]) > 0x2FF:
        return True
    v = sum(c in VOWELS for c in w)
    return v > 0 and v / len(w) >= 0.18 and (len(w) < 30)


@lru_cache(maxsize=200_000)
def _sort(w: str) -> int:
    """1 a common word, 2 another word in lower case, 0 any other."""
    return 1 if w.lower() in COMMON else 2 if w[0].islower() else 0


def _prose(words: list[str]) -> bool:
    """Does a stretch read as running text: common words inside, between words in lower case."""
    if len(words) < 4:
        return False
    sorts = [_sort(w) for w in words]
    first = sorts[0]
    common = sorts.count(1) - (first == 1)
    if common == 0:
        return False
    plain = sorts.count(2) - (first == 2)
    if plain >= 2 and common >= 2 and common + plain >= 0.3 * len(words):
        return True
    caps = sum(w[0].isupper() for w in words[1:])
    if all(w.isupper() for w in words if len(w) > 1):
        return common >= 2 or len(words) >= 5
    return plain >= 1 and (common >= 2 or plain >= 2 or caps * 2 < len(words)) and common + plain >= 0.3 * len(words)


def _columns(lines: list[str]) -> float:
    """Share of the lines that share the same two or more gutters: columns of characters where nearly all have a space."""
    n = len(lines)
    if n < 3:
        return 0.0
    width = int(np.median([len(x.rstrip()) for x in lines]))
    if not 6 <= width <= 400:
        return 0.0
    grid = np.frombuffer("".join(x.rstrip()[:width].ljust(width) for x in lines).encode("utf-32-le"), dtype=np.uint32).reshape(n, width)
    blank = (grid == 32).mean(axis=0) >= 0.97
    edges = np.flatnonzero(blank[:-1] & ~blank[1:])
    start = 1 if blank[0] else 0
    gutters = len(edges) - start
    return float(gutters) if gutters >= 2 else 0.0


def _period(x: np.ndarray) -> tuple[int, float]:
    """The lag, from 2 lines to a third of them, where a series is most like itself, and its autocorrelation there; 0, 0 if none.

    A lag only counts if a smaller one correlates less by 0.5: a series that just changes slowly has no period.
    """
    dev = x - x.mean()
    var = float(np.dot(dev, dev)) / len(x)
    best, least = (0, 0.0), 1.0
    if var < 1e-9:
        return best
    for lag in range(1, min(len(x) // 3, MAX_LAG) + 1):
        r = float(np.dot(dev[:-lag], dev[lag:])) / (len(x) - lag) / var
        if lag > 1 and r > best[1] + 1e-9 and least <= r - 0.5:
            best = (lag, r)
        least = min(least, r)
    return best


def describe(text: str) -> tuple:
    """The layout statistics of one text that isn't blank; see FIELDS."""
    text = BREAK.sub("\n", text).replace("\xa0", " ")
    raw = [x for x in text.split("\n") if x.strip()]
    total = sum(len(x.strip()) for x in raw) or 1
    marked = TAG.findall(text) if "<" in text or "&" in text or "{{" in text or "[[" in text or "]]" in text else []
    bare = TAG.sub(" ", text) if marked else text
    tags = sum(map(len, marked)) / len(text)
    words = WORD.findall(bare)
    letters = sum(map(len, words))
    marks = len(MARKS.findall(text))
    solid = sum(map(len, text.split())) or 1
    lengths = np.array([len(x.rstrip()) for x in raw], dtype=float)
    line_period, auto = _period(lengths)
    indent_period, indent_auto = _period(np.array([len(x) - len(x.lstrip()) for x in raw], dtype=float))

    # tables: the best delimiter, by the text that lies on lines of its most frequent number of columns
    table, table_lines, kind = 0.0, 0, ""
    rule = [bool(RULE.fullmatch(x)) for x in raw]
    body = [x for x, r in zip(raw, rule) if not r]
    for d in DELIMITERS:
        if text.count(d) < 2 * min(3, len(body)):
            continue
        cells = [_cells(x, d) if d in x else () for x in body]
        freq = Counter(len(c) for c in cells if len(c) >= 3)
        if not freq:
            continue
        k, n = max(freq.items(), key=lambda t: (t[1], t[0]))
        if n < 3 and not (n == 2 and len(body) == 2):
            continue
        rows = [(x, c) for x, c in zip(body, cells) if len(c) == k]
        long = sum(len(WORD.findall(v)) > 7 for _, c in rows for v in c) / (n * k)
        numeric = max(sum(bool(NUMBER.match(c[i])) for _, c in rows) / n for i in range(k))
        if d in ",;/" and (numeric < 0.6 or long > 0.15) or d not in ",;/" and long > 0.3:
            continue
        share = sum(len(x.strip()) for x, _ in rows) / total
        if share > table:
            table, table_lines, kind = share, n, d
    gaps = [x for x in body if GAP.search(x)] if "  " in text else []
    if len(gaps) >= 3:
        share = sum(len(x.strip()) for x in gaps) / total
        parts = [re.split(r" {2,}", x.strip()) for x in gaps]
        numeric = sum(any(NUMBER.match(v) for v in p) for p in parts) / len(parts)
        freq = Counter(len(p) for p in parts)
        same = max((v for k, v in freq.items() if k >= 3), default=0) / len(parts)
        if share > table and (_columns(gaps) >= 2 or same >= 0.8) and (numeric >= 0.5 or same >= 0.6):
            table, table_lines, kind = share, len(gaps), " "
    if table:
        table += sum(len(x.strip()) for x, r in zip(raw, rule) if r) / total

    # lines as prose, entries or neither; wrapped lines count with the line they go on in
    prose = entry = bullets = entries = stops = 0
    for x in raw:
        m = BULLET.match(x)
        w = WORD.findall(x[m.end() :] if m else x)
        size = len(x.strip())
        bullets += bool(m)
        stop = bool(STOP.search(x[-12:]))
        stops += stop
        if _prose(w) and not (m and len(w) <= 9 and not stop):
            prose += size
        elif w and len(w) <= 9 and not stop and (m or x.strip()[0].isupper() or not x.strip()[0].isalpha() or len(w) <= 4):
            entry += size
            entries += 1
    # a row of short entries within lines
    inline = 0.0
    parts_n = 0
    if prose < 0.5 * total:
        for d in INLINE:
            size = n = 0
            for x in raw:
                parts = [p for p in d.split(x.strip()) if p.strip()]
                if len(parts) >= 4:
                    short = [w for p in parts if len(w := WORD.findall(p)) <= 6 and not _prose(w)]
                    low = sum(any(_sort(c) == 2 for c in w) for w in short)
                    if len(short) >= 0.85 * len(parts) and low <= 0.5 * len(short):
                        size += len(x.strip())
                        n += len(parts)
            if size / total > inline:
                inline, parts_n = size / total, n

    # readable words
    counts = Counter(words)
    lone = sum(n for w, n in counts.items() if len(w) == 1)
    readable = sum(len(w) * n for w, n in counts.items() if _readable(w)) / solid
    # a single capital is a letter of an index rather than an article
    common = sum(n for w, n in counts.items() if _sort(w) == 1 and not (len(w) == 1 and w.isupper())) / len(words) if words else 0.0
    lower = sum(n for w, n in counts.items() if w[0].islower()) / len(words) if words else 0.0
    odd = len(ODD.findall(text)) / solid
    distinct = len({w.lower() for w in counts}) / len(words) if words else 0.0
    longest = max((len(x) for x in text.split()), default=0) / total
    return (len(words), common, letters / solid, marks / solid, tags, readable, odd, distinct, lone / len(words) if words else 1.0, longest, len(raw), bullets / len(raw), stops / len(raw), table, table_lines, prose / total, entry / total, entries, inline, parts_n, lower, auto, line_period, indent_auto, indent_period)


FIELDS = "n_words int, common double, letters double, marks double, tags double, readable double, odd double, distinct double, lone double, longest double, n_lines int, bullets double, stops double, table_share double, table_lines int, prose_share double, entry_share double, entries int, inline_share double, inline_parts int, lower double, line_autocorrelation double, line_period int, indent_autocorrelation double, indent_period int"
_NAMES = [x.split()[0] for x in FIELDS.split(", ")]
_TYPES = [pa.int32() if x.endswith(" int") else pa.float64() for x in FIELDS.split(", ")]


def _describe_all(id_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [describe(t) if t and not t.isspace() else (None,) * len(_NAMES) for t in b.column(1).to_pylist()]
            columns = list(zip(*rows)) if rows else [()] * len(_NAMES)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, type=t) for c, t in zip(columns, _TYPES)]], [id_name, *_NAMES])

    return run


def layout(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: the id and FIELDS, null where the text is null, empty or blank."""
    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(_describe_all(id_col), f"`{id_col}` {kind}, {FIELDS}")


def kind_of() -> Column:
    """list, table, junk, or null for prose, from the columns of layout()."""
    c = F.col
    repeated = (c("n_words") >= 12) & (c("distinct") < 0.12) & (c("prose_share") < 0.3)
    remains = (c("prose_share") <= 0.1) & (c("common") < 0.15) & (c("n_words") >= 5) & (c("distinct") < 0.7)
    menu = (c("prose_share") <= 0.1) & (c("common") < 0.15) & (c("distinct") < 0.45) & (c("entries") < 3) & c("n_words").between(8, 300)
    solid = (c("longest") >= 0.5) & (c("readable") < 0.75) & (c("common") < 0.06)
    junk = (c("tags") >= 0.35) | (c("readable") < 0.5) | (c("odd") >= 0.12) | solid | repeated | menu
    table = (c("table_share") >= 0.65) & (c("table_lines") >= 2)
    listed = (c("prose_share") <= 0.35) & ((c("entries") >= 3) & (c("entry_share") >= 0.6) | (c("inline_parts") >= 4) & (c("inline_share") >= 0.6))
    # records of several lines and entries that no mark shows: the layout repeats; names, titles and numbers, not sentences of any language
    repeats = (F.greatest("line_autocorrelation", "indent_autocorrelation") >= 0.6) & (c("n_lines") >= 6)
    records = repeats & (c("prose_share") <= 0.35) & (c("lower") <= 0.5) & (c("stops") <= 0.5) & (c("n_words") >= c("n_lines"))
    return F.when(table & (c("tags") < 0.35), "table").when(junk, "junk").when(listed | records, "list").when(remains, "junk")


def found(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, kind) of the texts of which by far the most is not prose."""
    return layout(df, id_col, text_col).select(id_col, kind_of().alias("kind")).where("kind IS NOT NULL")


def statistics(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Word count, mean word length, symbol ratio, share of lines that end in punctuation, share of common words.

    Words are runs of letters, digits and underscore; lines are split at \\n and counted if not blank;
    symbols are characters that are neither such, nor white space. All are null for a null text; ratios
    whose denominator is 0 are null.
    """
    t = F.col(text_col)
    words = F.regexp_extract_all(F.lower(t), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.trim(F.regexp_replace(x, r"[ \t\r\f]+", " "))) > 0)
    n = F.size("_words")
    base = df.select(F.col(id_col), t.alias("_t"), words.alias("_words"), lines.alias("_lines"))
    chars = F.aggregate("_words", F.lit(0), lambda a, w: a + F.length(w))
    ratio = lambda a, b: F.round(F.try_divide(a, F.nullif(b, F.lit(0))), 6)
    ended = F.size(F.filter("_lines", lambda x: x.rlike(r"[.!?:;,][\"'”’»)]*[ \t\r\f]*$")))
    known = F.size(F.filter("_words", lambda w: w.isin(sorted(COMMON))))
    symbols = F.length(F.regexp_replace("_t", r"[\p{L}\p{N}_\s]", ""))
    return base.select(
        id_col,
        F.when(F.col("_t").isNotNull(), n).cast("long").alias("n_words"),
        ratio(chars, n).alias("mean_word_length"),
        ratio(symbols, F.length("_t")).alias("symbol_ratio"),
        F.when(F.col("_t").isNotNull(), ratio(ended, F.size("_lines"))).alias("ended_lines"),
        F.when(F.col("_t").isNotNull(), ratio(known, n)).alias("common_share"),
    )
