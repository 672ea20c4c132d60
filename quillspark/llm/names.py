"""Linking the spellings of persons and organisations (problem 1).

A name is read into a core (the surname, or the place of an organisation) and a rest (the
given name, or the initials of the kind of organisation). Suffix blocking: the suffixes of
the cores are indexed from a minimum length; suffixes that are common (all of them, in a
large table) are refined with other fields (the first letter of the given name), never
dropped; given names, the commonest tokens of all, only count together with the start of
the core. Pairs of a block are compared by the ratio of the longest common subsequence.
What the other fields of a record prove comes on top: author and file name of one record
name the same entity, and so do equal author_viaf.

Only full names may join entities. A short form (initial, abbreviation) is read per record
with the fuller name beside it, and may therefore belong to several persons of a family
without joining them; where a record has none, it goes to the only entity it fits, if there
is exactly one.

Which given names are short forms is learned from the records that have both forms, which are
names of their own from their spread over surnames or a record that has them twice, and
which of two tokens is the given name from the number of partners each has in the corpus.

Odd input: null, empty and blank authors and null file names are no names; values that name
nobody, and joint values, are in no pair; an empty table gives an empty result; repeated
rows change nothing.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.components import components
from quillspark.session import written

#: Words that stand for nobody.
NOBODY = frozenset(
    """anonymous anonymus anonym anonyme anon unknown unbekannt ungenannt ungenannter nn lady gentleman dame herrn herr
    verfasser author autor inconnu anonimo nobody none null na sn ov ungenannte unnamed""".split()
)
#: Small words in a name that say nothing about who it is.
SMALL = frozenset("a an the by of in zu zum zur at for und and der die das dem den des ein eine einer einem".split())
PARTICLES = frozenset("von van vom de der den del della di du da la le les d v zu zum zur af ten ter am of the y e".split())
TITLES = frozenset(
    """dr prof rev hofrat miss mrs mr ms sir madame mme mlle monsieur frau herr fraulein frl lord baron baronin baroness graf grafin
    count countess freiherr freifrau frhr hon capt captain col colonel major general geheimrat pfarrer pastor professor doctor doktor
    reverend st mag med phil jun sen jr sr esq esquire dame ritter furst furstin prinz prinzessin prince princess duke duchess bishop
    abbe father justizrat kommerzienrat medizinalrat regierungsrat amtsrat hofratin senator consul konsul lieutenant lt leutnant""".split()
)
#: Heads of the names of organisations; a compound is split before its head.
HEADS = (
    "gesellschaft society societe institute institution institut office verein kontor comptoir kontoir bureau buero club klub bund company "
    "verlag press union association academy akademie library bibliothek museum college committee kommission guild gilde anstalt ges soc inst off assoc"
).split()
#: Shortest suffix and prefix of a core that is indexed.
SUFFIX = 4
#: Nodes of a block beyond which its key is refined.
HOT = 64

_LETTER = re.compile(r"[^\W\d_]+")


def fold(s: str) -> str:
    """Lower case without accents; ae, oe, ue count as the umlaut's letter."""
    s = unicodedata.normalize("NFKD", s.casefold().replace("ß", "ss"))
    s = "".join(c for c in s if not unicodedata.combining(c))
    return re.sub("ae", "a", re.sub("oe", "o", re.sub("ue", "u", s)))


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def close(a: str, b: str, least: float = 0.8) -> bool:
    """The longest common subsequence leaves out one letter, in long words two, and covers the ratio."""
    n = max(len(a), len(b))
    if a == b:
        return True
    k = lcs(a, b)
    return k >= n - (1 if n < 14 else 2) and k / n >= least


def is_short_of(short: str, full: str) -> bool:
    """May short stand for the given name full: its first letter or its letters in their order."""
    if short == full:
        return True
    if not short or not full or short[0] != full[0] or len(short) >= len(full):
        return False
    it = iter(full)
    return all(c in it for c in short)


def _person(tokens: list[str], raw: list[str], core_first: bool | None) -> tuple[str, str, bool] | None:
    """core, given, whether the given name is written as a short form (with a point or as an initial)."""
    keep = [(fold(t), r) for t, r in zip(tokens, raw)]
    keep = [(t, r) for t, r in keep if t]
    body = [(t, r) for t, r in keep if t not in TITLES]
    if core_first is None:
        while len(body) > 2 and body[0][0] in ("by", "von", "par", "de", "por"):
            body = body[1:]
        names = [(t, r) for k, (t, r) in enumerate(body) if not (t in PARTICLES and 0 < k < len(body) - 1 and (len(t) > 1 or r[0].islower()))]
        if not names:
            return None
        if len(names) == 1:
            return names[0][0], "", False
        core, rest = names[-1][0], names[:-1]
    else:
        names = body
        core, rest = names[0][0], names[1:]
    given, written_as = rest[0] if rest else ("", "")
    return core, given, bool(given) and (len(given) == 1 or written_as.endswith("."))


def _split(head: str) -> tuple[list[str], list[str]]:
    raw = re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)?\.?", head)
    return [x.rstrip(".") for x in raw], raw


def read_name(name: str) -> list[tuple[str, str, str, bool]]:
    """(kind, core, rest, short) of each entity the name names; none for nobody."""
    s = unicodedata.normalize("NFC", name).strip()
    from_file = "_" in s
    s = re.sub(r"[\[(]?\s*(?:\*|geb\.?|b\.)?\s*\d{3,4}\s*[-–—/]?\s*(?:\d{3,4})?\s*[\])]?", " ", s)
    s = re.sub(r"\s+", " ", s).strip(" ,;")
    if s.startswith("[") and s.endswith("]") or s.startswith("(") and s.endswith(")"):
        s = s[1:-1].strip()
    letters = [fold(x) for x in _LETTER.findall(s)]
    if not letters or all(x in NOBODY or x in SMALL or x in PARTICLES or x in TITLES for x in letters) or "".join(letters) in NOBODY:
        return []
    flat = re.sub(r"[_\-\s]+", " ", s)
    words = [fold(x) for x in _LETTER.findall(flat)]
    heads = [w for w in words if any(w == h or (len(w) > len(h) + 2 and len(h) > 3 and w.endswith(h)) or (h == "ges" and w.endswith("ges") and len(w) > 5 and re.search(rf"\b{w}\.", fold(s))) for h in HEADS)]
    abbreviated = re.match(r"^V\. ?d\. ", s)
    if heads or abbreviated:
        return _organisation(s, from_file, heads)
    if from_file:
        a, _, b = s.partition("_")
        if a.count("-") == 1 and b.count("-") == 1 and all(re.split("-", a)) and all(re.split("-", b)):
            (a1, a2), (b1, b2) = a.split("-"), b.split("-")
            return [("person", fold(a1), fold(b1), len(b1) == 1), ("person", fold(a2), fold(b2), len(b2) == 1)]
        core, given = "".join(fold(x) for x in _LETTER.findall(a)), [fold(x) for x in _LETTER.findall(b)]
        given = given[0] if given else ""
        return [("person", core, given, len(given) == 1)] if core else [("person", given, "", False)]
    for sep in (r"\s*\|\s*", r"\s*;\s*", r"\s+&\s+", r"\s+(?:and|und|et|y)\s+", r"\s+/\s+"):
        parts = [p for p in re.split(sep, s) if _LETTER.search(p)]
        if len(parts) > 1:
            out = [e for p in parts for e in read_name(p)]
            if len(out) > 1:
                return out
    if "," in s:
        last, _, first = s.partition(",")
        lt, lr = _split(last)
        ft, fr = _split(first)
        last_names = [x for x in map(fold, lt) if x not in PARTICLES and x not in TITLES] or [fold(x) for x in lt]
        first_names = [(fold(t), r) for t, r in zip(ft, fr) if fold(t) not in TITLES and not (fold(t) in PARTICLES and (len(t) > 1 or t.islower()))]
        core = "".join(last_names)
        given, written_as = first_names[0] if first_names else ("", "")
        return [("person", core, given, bool(given) and (len(given) == 1 or written_as.endswith(".")))] if core else []
    tokens, raw = _split(s[:-1] if s.endswith(".") and len(s) > 3 and s[-3] not in " ." else s)
    out = _person(tokens, raw, None)
    return [("person", *out)] if out else []


def _organisation(s: str, from_file: bool, heads: list[str]) -> list[tuple[str, str, str, bool]]:
    """The place is what no small or kind word is; the rest is the sorted initials of the words of its kind."""
    parts = re.split(r"[_\s]+", re.sub(r"[(),]", " ", s))
    tokens = [fold("".join(_LETTER.findall(x))) for p in parts for x in (p.split("-") if "-" in p else [p])]
    tokens = [t for t in tokens if t and t not in SMALL and t not in PARTICLES or t == "v" and tokens.index(t) == 0]
    is_kind = lambda t: t in heads or any(t.startswith(h[:3]) and len(h) > 3 and len(t) <= len(h) and t == h for h in HEADS)
    at = [k for k, t in enumerate(tokens) if is_kind(t)]
    # the place is the longest token that is neither head nor beside it in the dictionary of kinds
    rest = [t for k, t in enumerate(tokens) if k not in at and not _kind_word(t)]
    if not rest:
        return []
    place = max(rest, key=len)
    kinds = [t for t in tokens if t != place]
    letters = []
    for t in kinds:
        head = next((h for h in sorted(HEADS, key=len, reverse=True) if t.endswith(h) and len(t) > len(h) + 1), None)
        letters += [t[0], head[0]] if head and t not in HEADS else [t[0]]
    return [("org", place, "".join(sorted(letters)), False)]


#: Words beside the head in the names of organisations, as beginnings.
KIND_WORDS = ("liter", "lit", "read", "rdg", "alman", "alm", "kal", "erz", "lese", "histor", "hist", "music", "mus", "agric", "philos", "phil", "roy", "kgl", "konig", "publ", "circul", "leih", "kunst", "nat")


def _kind_word(t: str) -> bool:
    return any(t == k or (len(k) > 3 and t.startswith(k)) for k in KIND_WORDS) or any(t.endswith(h) and len(h) > 4 for h in HEADS) or len(t) == 1


ENTRY = "array<struct<kind:string,core:string,rest:string,short:boolean>>"


def _read_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("core", pa.string()), ("rest", pa.string()), ("short", pa.bool_())]))
    for b in batches:
        rows = [[dict(zip(("kind", "core", "rest", "short"), e)) for e in read_name(n)] for n in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, type=kind)], ["name", "entries"])


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the candidate pairs that may be the same: cores close, and the rest the same or a slip or short form."""
    for b in batches:
        keep = []
        for core_a, rest_a, core_b, rest_b, full_a, full_b, kind in zip(*(b.column(c).to_pylist() for c in ("core_a", "rest_a", "core_b", "rest_b", "full_a", "full_b", "kind"))):
            same_core, ok = core_a == core_b, False
            near = same_core or (min(len(core_a), len(core_b)) >= 5 and close(core_a, core_b))
            if kind == "org":
                adjective = any(x.startswith(y) and x[len(y) :] in ("er", "r", "ers", "s", "n") for x, y in ((core_a, core_b), (core_b, core_a)))
                adjective = adjective or any(x.endswith("er") and close(x[:-2], y) for x, y in ((core_a, core_b), (core_b, core_a)))
                ok = rest_a == rest_b and (near or adjective)
            elif near:
                if rest_a == rest_b:
                    ok = True
                elif full_a and full_b:
                    ok = False  # two given names of the corpus
                elif is_short_of(rest_a, rest_b) and not full_a or is_short_of(rest_b, rest_a) and not full_b:
                    ok = same_core
                else:
                    ok = same_core and min(len(rest_a), len(rest_b)) >= 4 and close(rest_a, rest_b)
            keep.append(ok)
        yield b.filter(pa.array(keep, type=pa.bool_()))


def records(df: DataFrame, key: str = "text_id", author: str = "author", file_name: str = "file_name", viaf: str = "author_viaf") -> DataFrame:
    """(rec, author, fn, viaf): the distinct name fields of the records."""
    part = F.when(F.col(file_name).isNotNull(), F.array_join(F.slice(F.split(F.col(file_name), "_"), 1, 2), "_"))
    clean = F.ltrim(F.lit("0"), F.regexp_replace(F.col(viaf), r"\s+", "")) if viaf else F.lit(None).cast("string")
    return df.select(F.col(key).alias("rec"), F.when(F.col(author) != "", F.col(author)).alias("author"), part.alias("fn"), F.nullif(clean, F.lit("")).alias("viaf")).distinct()


class Linked:
    """What link() found: names (name, entity) and records (rec, entity); both may hold several rows a name or record."""

    def __init__(self, names: DataFrame, recs: DataFrame):
        self.names, self.recs = names, recs


def link(df: DataFrame, use_viaf: bool = True, **columns: str) -> Linked:
    rec = written(records(df, **columns))
    if not use_viaf:
        rec = rec.withColumn("viaf", F.lit(None).cast("string"))
    long = rec.select("rec", "viaf", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("author").alias("name")), F.struct(F.lit("f").alias("side"), F.col("fn").alias("name")))).alias("x")).select("rec", "viaf", "x.side", "x.name").where("name IS NOT NULL")
    read = long.select("name").distinct().mapInArrow(_read_all, f"name string, entries {ENTRY}")
    flat = written(read.select("name", F.size("entries").alias("n"), F.posexplode("entries").alias("pos", "e")).select("name", "n", "pos", "e.*"))

    # given names have many partners, surnames few: turn the entries that have them the wrong way round
    person = flat.where("kind = 'person' AND rest <> ''")
    partners = person.select(F.col("rest").alias("token"), F.col("core").alias("other")).distinct().groupBy("token").agg(F.count("*").alias("as_given"))
    flat = flat.join(partners.select(F.col("token").alias("core"), F.col("as_given").alias("gc")), "core", "left").join(partners.select(F.col("token").alias("rest"), F.col("as_given").alias("gr")), "rest", "left")
    turn = (F.col("kind") == "person") & (F.length("rest") > 1) & (F.coalesce("gc", F.lit(0)) >= 3) & (F.coalesce("gc", F.lit(0)) > 2 * F.coalesce("gr", F.lit(0)))
    flat = flat.select("name", "n", "pos", "kind", F.when(turn, F.col("rest")).otherwise(F.col("core")).alias("core"), F.when(turn, F.col("core")).otherwise(F.col("rest")).alias("rest"), (F.col("short") & ~turn).alias("short"))
    flat = written(flat)

    # short forms, learned from records with both: the shorter of two forms of the same person
    single = long.join(flat.where("n = 1"), "name")
    side = lambda s: single.where(F.col("side") == s).select("rec", *[F.col(c).alias(f"{c}_{s}") for c in ("name", "kind", "core", "rest", "short")])
    both = side("a").join(side("f"), "rec").where("kind_a = kind_f")
    person = written(both.where("kind_a = 'person' AND rest_a <> '' AND rest_f <> ''").select("rest_a", "rest_f", "short_a", "short_f", "core_f"))
    alike = written(person.where("NOT short_a AND NOT short_f AND rest_a = rest_f").groupBy(F.col("rest_a").alias("rest")).agg(F.count("*").alias("alike")))
    forms = person.where("rest_a <> rest_f").groupBy(F.least("rest_a", "rest_f").alias("x"), F.greatest("rest_a", "rest_f").alias("y")).agg(F.count("*").alias("n"), F.count_distinct("core_f").alias("cores"))
    forms = forms.join(alike.select(F.col("rest").alias("x"), F.col("alike").alias("ax")), "x", "left").join(alike.select(F.col("rest").alias("y"), F.col("alike").alias("ay")), "y", "left")
    # the shorter of two is the short form, of two as long the one that stands less often beside itself
    first = F.struct(F.length("x").alias("l"), F.coalesce("ax", F.lit(0)).alias("n"), F.col("x").alias("w")) <= F.struct(F.length("y").alias("l"), F.coalesce("ay", F.lit(0)).alias("n"), F.col("y").alias("w"))
    # a nickname shares only some letters with the full form; short forms of many persons are learned as they stand
    forms = written(forms.select("n", "cores", F.when(first, F.col("x")).otherwise(F.col("y")).alias("less"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("more"), F.when(first, F.col("ax")).otherwise(F.col("ay")).alias("own")))
    nick = forms.where((F.col("cores") >= 2) & (F.col("n") > F.coalesce("own", F.lit(0)))).select("less", "more")
    shorter = (F.length("less") < F.length("more")) | (F.col("n") > F.coalesce("own", F.lit(0))) & (F.col("cores") >= 2)
    seen = forms.select(F.col("less").alias("rest"), F.when(shorter, F.col("n")).otherwise(0).alias("as_short"), F.when(shorter, 0).otherwise(F.col("n")).alias("as_full"))
    seen = seen.unionByName(forms.where(shorter).select(F.col("more").alias("rest"), F.lit(0).alias("as_short"), F.col("n").alias("as_full")))
    seen = seen.unionByName(alike.select("rest", F.lit(0).alias("as_short"), F.col("alike").alias("as_full")))
    seen = seen.groupBy("rest").agg(F.sum("as_short").alias("as_short"), F.sum("as_full").alias("as_full"))
    spread = flat.where("kind = 'person' AND NOT short").groupBy("rest").agg(F.countDistinct("core").alias("spread"))
    lexicon = spread.join(seen, "rest", "full").join(alike, "rest", "left")
    lexicon = lexicon.select("rest", (F.coalesce("as_short", F.lit(0)) > F.coalesce("as_full", F.lit(0))).alias("learned_short"), ((F.coalesce("spread", F.lit(0)) >= 3) | (F.coalesce("alike", F.lit(0)) >= 1)).alias("spread"))
    flat = flat.join(lexicon, "rest", "left")
    short = F.col("short") | (F.length("rest") <= 2) | F.coalesce("learned_short", F.lit(False))
    flat = flat.select("name", "n", "pos", "kind", "core", "rest", ((F.col("kind") == "person") & short).alias("short"), (F.coalesce("spread", F.lit(False)) & ~F.col("short")).alias("common"))
    flat = written(flat.withColumn("node", F.concat_ws("\x1f", "kind", "core", "rest")))

    # the nodes that may join entities: organisations and persons with a full given name
    on = written(long.join(flat, "name"))
    nodes = written(on.select("node", "kind", "core", "rest", "short", "common").distinct())
    sure = ["node", "kind", "core", "rest", "common"]
    cand = _candidates(nodes.where("NOT short").select(*sure))
    proof = both_edges(on)
    edges = cand.unionByName(proof).unionByName(nodes.where("NOT short").select(F.col("node").alias("a"), F.col("node").alias("b")))
    label = components(edges)

    # each name of each record: its own node, or for a short form the full one beside it or the record's viaf
    full = on.where("NOT short AND n = 1").groupBy("rec").agg(F.min("node").alias("beside"))
    viaf = on.where("NOT short AND n = 1 AND viaf IS NOT NULL").groupBy("viaf").agg(F.min("node").alias("by_viaf"))
    placed = on.join(full, "rec", "left").join(viaf, "viaf", "left")
    to = F.when(~F.col("short"), F.col("node")).when(F.col("n") == 1, F.coalesce("beside", "by_viaf"))
    placed = placed.select("rec", "name", "n", "pos", "node", "core", "rest", to.alias("to"))
    placed = written(placed.join(label.select(F.col("node").alias("to"), F.col("component").alias("entity")), "to", "left"))

    # short forms with nothing beside them: the only entity they fit, else one of their own
    open_ = written(placed.where("entity IS NULL").select("node", "core", "rest").distinct())
    fits = _fitting(open_, nodes.where("NOT short AND kind = 'person'"), label, nick)
    only = written(fits.groupBy("node").agg(F.min("entity").alias("fit"), F.countDistinct("entity").alias("ways")).where("ways = 1").select("node", "fit"))
    known = placed.where("entity IS NOT NULL AND n = 1").groupBy("node").agg(F.min("entity").alias("was"), F.countDistinct("entity").alias("ways")).where("ways = 1").select("node", "was")
    done = written(placed.join(only, "node", "left").join(known, "node", "left").select("rec", "name", "n", "node", F.coalesce("entity", "was", "fit").alias("entity")))
    # names of one record are of one entity: one that is still open takes that of the other, or they share the open ones
    in_rec = done.where("n = 1").groupBy("rec").agg(F.collect_set("entity").alias("found"), F.collect_set(F.when(F.col("entity").isNull(), F.concat(F.lit("?"), "node"))).alias("open"))
    done = done.join(in_rec, "rec", "left")
    alone = F.array(F.concat(F.lit("?"), "node"))
    to = F.when(F.col("entity").isNotNull(), F.array("entity")).when(F.col("n") > 1, alone).when(F.size("found") > 0, F.col("found")).otherwise(F.col("open"))
    done = written(done.select("rec", "name", "n", F.explode(to).alias("entity")).distinct())
    return Linked(done.where("n = 1").select("name", "entity").distinct(), done.select("rec", "entity").distinct())


def both_edges(on: DataFrame) -> DataFrame:
    """Edges between the full names of one record, and of one viaf."""
    sure = on.where("NOT short AND n = 1")
    a = sure.where("side = 'a'").select("rec", F.col("node").alias("a"), F.col("kind").alias("ka"))
    b = sure.where("side = 'f'").select("rec", F.col("node").alias("b"), F.col("kind").alias("kb"))
    rec = a.join(b, "rec").where("ka = kb AND a <> b").select("a", "b").distinct()
    first = sure.where("viaf IS NOT NULL").groupBy("viaf").agg(F.min("node").alias("a"))
    via = sure.where("viaf IS NOT NULL").select("viaf", F.col("node").alias("b")).distinct().join(first, "viaf").where("a <> b").select("a", "b").distinct()
    return rec.unionByName(via)


def _keys(kind: Column, core: Column, rest: Column) -> Column:
    """Block keys: suffix and prefix of the core refined with the first letter of the rest; start and end of the rest with the whole core."""
    low = F.when(F.length(core) < 8, F.lit(3)).otherwise(F.lit(SUFFIX))
    one = F.substring(rest, 1, 1)
    stem = F.when(kind == "org", F.regexp_replace(core, "er?$", "")).otherwise(core)
    return F.array(
        F.concat_ws("\x1f", F.lit("s"), kind, F.right(stem, low), F.when(kind == "org", rest).otherwise(one)),
        F.concat_ws("\x1f", F.lit("p"), kind, F.left(stem, low), F.when(kind == "org", rest).otherwise(one)),
        F.concat_ws("\x1f", F.lit("r"), kind, core, F.right(rest, F.lit(3))),
        F.concat_ws("\x1f", F.lit("q"), kind, core, F.left(rest, F.lit(2))),
    )


def variants(core: Column) -> Column:
    """What close() lets a core have in common with another: itself and itself without one letter, from 14 letters also without two.

    Two cores are close only if they share one of these, so refining a block with them loses no pair.
    """
    less = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    one = F.when(F.length(core) > 0, less(core)).otherwise(F.array().cast("array<string>"))
    two = F.when(F.length(core) >= 14, F.flatten(F.transform(one, less))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(core), one, two))


def refined(keyed: DataFrame, hot: DataFrame, core: str, key: str = "key") -> DataFrame:
    """keyed with the keys of blocks in hot (key) split by the variants of the core."""
    there = F.col("_hot").isNotNull() & F.col(key).rlike("^[sp]\x1fperson")
    parts = F.when(there, F.transform(variants(F.col(core)), lambda v: F.concat_ws("\x1f", key, v))).otherwise(F.array(key))
    return keyed.join(hot.select(key, F.lit(True).alias("_hot")), key, "left").withColumn(key, F.explode(parts)).drop("_hot")


def _candidates(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) between the nodes of a block whose longest common subsequence is long enough.

    Cores under 8 letters are indexed by 3 letters, so a core of 8 is indexed under both lengths. Blocks of
    common suffixes (over HOT nodes) are refined first with the letter of the given name, which all are,
    and then with the variants of the core; what is left in one is compared.
    """
    keyed = nodes.withColumn("key", F.explode(F.array_distinct(_keys(F.col("kind"), F.col("core"), F.col("rest")))))
    both = keyed.where((F.length("core") == 8)).withColumn("key", F.explode(F.array(F.concat_ws("\x1f", F.lit("s"), "kind", F.right("core", F.lit(3)), F.substring("rest", 1, 1)), F.concat_ws("\x1f", F.lit("p"), "kind", F.left("core", F.lit(3)), F.substring("rest", 1, 1)))))
    keyed = written(keyed.unionByName(both).distinct())
    hot = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT)
    keyed = refined(keyed, hot, "core")
    a = keyed.select("key", "kind", *[F.col(c).alias(f"{c}_a") for c in ("node", "core", "rest")], F.col("common").alias("full_a"))
    b = keyed.select("key", *[F.col(c).alias(f"{c}_b") for c in ("node", "core", "rest")], F.col("common").alias("full_b"))
    near = F.abs(F.length("core_a") - F.length("core_b")) <= 3
    pairs = a.join(b, "key").where((F.col("node_a") < F.col("node_b")) & near).drop("key").distinct()
    judged = pairs.mapInArrow(_judge, pairs.schema)
    return judged.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def _fitting(open_: DataFrame, nodes: DataFrame, label: DataFrame, nick: DataFrame) -> DataFrame:
    """(node, entity): the entities of full names that a short form may stand for, by core first and slips of the core after."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = (b.column(c).to_pylist() for c in ("core", "rest", "core_b", "rest_b", "learned"))
            keep = [close(c, d) and (r == "" or learned or is_short_of(r, s)) for c, r, d, s, learned in zip(*cols)]
            yield b.filter(pa.array(keep, type=pa.bool_()))

    def keyed(d: DataFrame, core: str) -> DataFrame:
        low = F.lit(SUFFIX)
        return d.withColumn("key", F.explode(F.array(F.concat(F.lit("s\x1fperson\x1f"), F.right(core, low)), F.concat(F.lit("p\x1fperson\x1f"), F.left(core, low)))))

    target = nodes.join(label, "node").select(F.col("core").alias("core_b"), F.col("rest").alias("rest_b"), F.col("component").alias("entity")).distinct()
    one, other = keyed(open_, "core"), keyed(target, "core_b")
    hot = other.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT)
    met = refined(one, hot, "core").join(refined(other, hot, "core_b"), "key")
    pairs = met.where((F.abs(F.length("core") - F.length("core_b")) <= 2) & ((F.left("rest", F.lit(1)) == F.left("rest_b", F.lit(1))) | (F.length("rest") > 1) | (F.col("rest") == "")))
    known = nick.select(F.col("less").alias("rest"), F.col("more").alias("rest_b"), F.lit(True).alias("learned"))
    pairs = pairs.drop("key").distinct().join(known, ["rest", "rest_b"], "left").withColumn("learned", F.coalesce("learned", F.lit(False)))
    fit = pairs.mapInArrow(judge, pairs.schema)
    exact = fit.withColumn("same", F.col("core") == F.col("core_b"))
    best = exact.groupBy("node").agg(F.max("same").alias("best"))
    return exact.join(best, "node").where("same = best").select("node", "entity").distinct()


def pairs(linked: Linked) -> DataFrame:
    """(name_a, name_b): every two names of one entity, name_a < name_b in code point order."""
    a, b = linked.names.select("entity", F.col("name").alias("name_a")), linked.names.select("entity", F.col("name").alias("name_b"))
    return a.join(b, "entity").where("name_a < name_b").select("name_a", "name_b").distinct()
