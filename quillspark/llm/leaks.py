"""Test items that leak into training text (problem 7).

Rare n-grams of the items are seeds; documents that hold enough seeds of an item are its
candidates, and Smith-Waterman alignment then finds the stretches that an edited copy has
in common with the item, until those found cover the item or none is long enough. A part
of the document takes part in the alignment if it lies within MARGIN words of where a seed
puts the item; item and document are aligned in blocks, so a task needs the same memory for
texts of any length.

The seeds are words folded to their letters. Wording that several items share is neither a
seed nor one of an item's own words; items that are near-copies of each other (five words,
0.8) count as one there, so a test item in three suites is not shared wording, and the
same words are aligned once. An item whose every n-gram is in many others keeps its rarest
ones as seeds.

Up to BROADCAST_SEEDS seeds are broadcast with their items, and a document is read once,
with no shuffle; beyond that only bit maps of fixed size are broadcast, which let out the
hits, and then the texts of candidates, and these are joined by shuffles. Both ways give the
same rows. Copies of a text are aligned once a batch, so a third of all documents may hold
the same item.

Odd input: null and empty texts and items, and items with fewer own words than MIN_OWN, are
in no row; repeated rows give the same pair once; texts are read whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators import neardup
from quillspark.session import written

#: Words in a seed.
SEED = 5
#: An n-gram that more classes of items than this have is no seed, unless it is among the KEEP_SEEDS rarest of its item.
SHARED_SEEDS, KEEP_SEEDS = 4, 24
#: A word that a SPAN-gram covers which more classes of items than SHARED_SPANS have isn't the item's own.
SPAN, SHARED_SPANS = 8, 2
#: Share of the item's seeds that makes a candidate, and their number at least.
SEED_SHARE, SEED_LEAST = 0.1, 3
#: Own words an item needs, and matched words a stretch needs.
MIN_OWN, MIN_STRETCH = 8, 6
#: Share of the item's own words that is a leak.
LEAK = 0.4
#: Words around the place of the item that are aligned, and words of the item and of the document in a block.
MARGIN, ITEM_BLOCK, DOC_BLOCK = 2048, 512, 8192
#: Seeds that are broadcast at most, at 16 bytes, and words of their items, four times as many at 9 bytes.
BROADCAST_SEEDS = 2_000_000
#: Bits of the bit map: 16 MB whatever the number of seeds.
MAP_BITS = 1 << 27

WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def fold(text: str) -> str:
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


class Words:
    """Numbers for words: a 64-bit hash of each, kept for the words seen most recently."""

    def __init__(self) -> None:
        import xxhash

        self.hash, self.seen = xxhash.xxh64_intdigest, {}

    def of(self, text: str | None) -> np.ndarray:
        seen, out = self.seen, []
        if len(seen) > 500_000:
            seen.clear()
        for w in WORD.findall(fold(text or "")):
            h = seen.get(w)
            if h is None:
                h = seen[w] = self.hash(w)
            out.append(h)
        return np.array(out, dtype=np.uint64)


def grams(w: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of n words."""
    if len(w) < n:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(w) - n + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = (out ^ w[k : len(w) - n + 1 + k]) * _MIX
            out ^= out >> np.uint64(29)
    return out


def _best(rows: np.ndarray, doc: np.ndarray) -> tuple[int, int, np.ndarray]:
    """The best local alignment, match 1, mismatch and gap -1: its score, where it ends in rows, and the rows it matches."""
    n = len(doc)
    steps = np.arange(n + 1, dtype=np.int32)
    h = np.zeros((len(rows) + 1, n + 1), dtype=np.int32)
    same = rows[:, None] == doc[None, :]
    for i in range(1, len(rows) + 1):
        t = np.maximum(h[i - 1] - 1, 0)
        np.maximum(t[1:], h[i - 1, :-1] + np.where(same[i - 1], 1, -1), out=t[1:])
        h[i] = np.maximum.accumulate(t + steps) - steps
    i, j = np.unravel_index(int(h.argmax()), h.shape)
    score, end, hits = int(h[i, j]), int(i), []
    if score < MIN_STRETCH:
        return score, end, np.zeros(0, dtype=np.int64)
    while h[i, j] > 0:
        if same[i - 1, j - 1] and h[i, j] == h[i - 1, j - 1] + 1:
            hits.append(i - 1)
            i, j = i - 1, j - 1
        elif h[i, j] == h[i - 1, j - 1] - 1:
            i, j = i - 1, j - 1
        elif h[i, j] == h[i - 1, j] - 1:
            i -= 1
        else:
            j -= 1
    return score, end, np.array(hits[::-1], dtype=np.int64)


def blocks(doc: np.ndarray, places: list[tuple[int, int]]) -> list[np.ndarray]:
    """The parts of doc that the places (from, to) cover, joined where they meet, in overlapping blocks of DOC_BLOCK words."""
    out, last = [], 0
    joined: list[list[int]] = []
    for a, b in sorted(places):
        a, b = max(0, a), min(len(doc), b)
        if joined and a <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], b)
        elif a < b:
            joined.append([a, b])
    for a, b in joined:
        while a < b:
            last = min(b, a + DOC_BLOCK)
            out.append(doc[a:last])
            a = b if last == b else last - 2 * ITEM_BLOCK
    return out


def stretches(item: np.ndarray, doc: np.ndarray, own: np.ndarray, most: int | None = None, places: list[tuple[int, int]] | None = None) -> int:
    """Own words of the item that the best local alignments match, each in the part of the item no better one has.

    A part of the item is aligned with all blocks of the document (those at places, if given); most is the number of
    alignments taken, all by default.
    """
    total, found = 0, 0
    parts = blocks(doc, [(0, len(doc))] if places is None else places)
    todo = [(a, min(len(item), a + ITEM_BLOCK)) for a in range(0, len(item), ITEM_BLOCK)][::-1]
    while todo and (most is None or found < most):
        a, b = todo.pop()
        if b - a < MIN_STRETCH:
            continue
        score, end, hits = max((_best(item[a:b], d) for d in parts), key=lambda x: x[0], default=(0, 0, np.zeros(0, dtype=np.int64)))
        if score < MIN_STRETCH:
            continue
        found += 1
        total += int(own[a + hits].sum())
        todo += [(a, a + int(hits[0])), (a + end, b)]
    return total


def places(seeds: np.ndarray, at: np.ndarray, length: int, doc: np.ndarray) -> tuple[int, list[tuple[int, int]]]:
    """How many of the item's seeds the n-grams of a document hold, and where they put the item. seeds is sorted, at are their places."""
    lo, hi = np.searchsorted(seeds, doc, "left"), np.searchsorted(seeds, doc, "right")
    hit = np.flatnonzero(hi > lo)
    where = [(int(j) - int(at[k]) - MARGIN, int(j) - int(at[k]) + length + MARGIN) for j in hit for k in (lo[j], hi[j] - 1)]
    return len(np.unique(lo[hit])), where


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = Words()
    for b in batches:
        w = [words.of(t) for t in b.column(1).to_pylist()]
        spans = [grams(x, SPAN).astype(np.int64).tolist() for x in w]
        seeds = [grams(x, SEED).astype(np.int64).tolist() for x in w]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([x.tobytes() for x in w], type=pa.binary()), pa.array(spans, type=pa.list_(pa.int64())), pa.array(seeds, type=pa.list_(pa.int64()))],
            ["item", "words", "spans", "seeds"],
        )


def prepared(items: DataFrame, item_id: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items (item, words, own, n_own, seeds, at, need), their seeds (gram, item), and the ids of each (id, item).

    item is the smallest id of those with the same words; only items with enough own words are left.
    """
    kind = items.schema[item_id].dataType.simpleString()
    texts = items.select(F.col(item_id).alias("item"), F.col(text).alias("text")).where(F.col("item").isNotNull() & F.col("text").isNotNull()).distinct()
    every = written(texts.select("item", "text").mapInArrow(_item_rows, f"item {kind}, words binary, spans array<long>, seeds array<long>"))
    first = written(every.groupBy("words").agg(F.min("item").alias("item"), F.first("spans").alias("spans"), F.first("seeds").alias("seeds")))
    same = written(every.select(F.col("item").alias("id"), "words").join(first.select("words", "item"), "words").select("id", "item").distinct())
    # near-copies are one class; an id with several texts counts by each
    one = texts.groupBy("item").agg(F.min("text").alias("text")).join(first.select("item"), "item", "left_semi")
    classes = neardup.classes(one, "item", "text", SEED, 0.8).select("item", F.col("class_id").alias("of"))
    rows = written(first.join(classes, "item"))
    at = rows.select("item", "of", F.posexplode("spans").alias("pos", "span"))
    shared = at.groupBy("span").agg(F.count_distinct("of").alias("n")).where(F.col("n") > SHARED_SPANS).select("span")
    covered = at.join(shared, "span").groupBy("item").agg(F.collect_set("pos").alias("shared_at"))
    rows = rows.join(covered, "item", "left")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            masks, counts, seeds, places_ = [], [], [], []
            for w, at, grams_ in zip(b.column("words").to_pylist(), b.column("shared_at").to_pylist(), b.column("seeds").to_pylist()):
                mask = np.ones(len(w) // 8, dtype=np.uint8)
                for p in at or ():
                    mask[p : p + SPAN] = 0
                masks.append(mask.tobytes())
                counts.append(int(mask.sum()))
                mine = [k for k in range(len(grams_)) if mask[k : k + SEED].any()]
                seeds.append([grams_[k] for k in mine])
                places_.append(mine)
            yield pa.RecordBatch.from_arrays(
                [b.column("item"), b.column("of"), b.column("words"), pa.array(masks, type=pa.binary()), pa.array(counts, type=pa.int32()), pa.array(seeds, type=pa.list_(pa.int64())), pa.array(places_, type=pa.list_(pa.int32()))],
                ["item", "of", "words", "own", "n_own", "grams", "pos"],
            )

    full = written(rows.select("item", "of", "words", "shared_at", "seeds").mapInArrow(own, f"item {kind}, of {kind}, words binary, own binary, n_own int, grams array<long>, pos array<int>").where(F.col("n_own") >= MIN_OWN))
    flat = full.select("item", "of", F.explode(F.arrays_zip("grams", "pos")).alias("x")).select("item", "of", F.col("x.grams").alias("gram"), F.col("x.pos").alias("pos"))
    held = flat.groupBy("gram").agg(F.count_distinct("of").alias("n"))
    rank = F.dense_rank().over(Window.partitionBy("item").orderBy("n", "gram"))
    kept = flat.join(held, "gram").withColumn("rank", rank).where((F.col("n") <= SHARED_SEEDS) | (F.col("rank") <= KEEP_SEEDS)).select("item", "gram", "pos")
    lists = kept.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("gram", "pos"))).alias("s"), F.count_distinct("gram").alias("n_seeds"))
    need = F.greatest(F.lit(SEED_LEAST), F.ceil(F.col("n_seeds") * SEED_SHARE)).cast("int").alias("need")
    full = written(full.select("item", "words", "own", "n_own").join(lists, "item").select("item", "words", "own", "n_own", need, F.col("s.gram").alias("seeds"), F.col("s.pos").alias("at")))
    return full, full.select("item", F.explode("seeds").alias("gram")).distinct(), same


def _candidates_of(g: np.ndarray, gram: np.ndarray, of: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Numbers of the items enough of whose seeds are among the n-grams of a document. gram is sorted, of has the item of each."""
    g = np.unique(g)
    lo = np.searchsorted(gram, g, "left")
    there = lo < len(gram)
    there[there] = gram[lo[there]] == g[there]
    if not there.any():
        return np.zeros(0, dtype=np.int64)
    lo, n = lo[there], np.searchsorted(gram, g[there], "right") - lo[there]
    ends = np.cumsum(n)
    at, count = np.unique(of[np.repeat(lo - (ends - n), n) + np.arange(ends[-1])], return_counts=True)
    return at[count >= need[at]]


def _scan(shared, id_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, of, need, ids, item_words, own, n_own, seeds, at, item_type = shared.value
        words = Words()
        for b in batches:
            done: dict[str, list[tuple[int, float]]] = {}
            docs, found, held = [], [], []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not text or doc_id is None:
                    continue
                if text not in done:
                    w = words.of(text)
                    g = grams(w, SEED).astype(np.int64)
                    done[text] = [(k, stretches(item_words[k], w, own[k], places=places(seeds[k], at[k], len(own[k]), g)[1]) / n_own[k]) for k in _candidates_of(g, gram, of, need)]
                for k, share in done[text]:
                    docs.append(doc_id)
                    found.append(ids[k])
                    held.append(share)
            yield pa.RecordBatch.from_arrays([pa.array(docs, type=b.schema.field(0).type), pa.array(found, type=item_type), pa.array(held, type=pa.float64())], [id_name, "item", "share"])

    return run


def _hits(bits, id_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, table = Words(), bits.value
        for b in batches:
            docs, out = [], []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not text or doc_id is None:
                    continue
                g = np.unique(grams(words.of(text), SEED).astype(np.int64))
                at = g.astype(np.uint64) % np.uint64(MAP_BITS)
                g = g[(table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
                docs += [doc_id] * len(g)
                out.append(g)
            yield pa.RecordBatch.from_arrays([pa.array(docs, type=b.schema.field(0).type), pa.array(np.concatenate(out) if out else np.zeros(0, dtype=np.int64))], [id_name, "gram"])

    return run


def _map_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bit map that a partition of numbers sets."""
    table = np.zeros(MAP_BITS // 8, dtype=np.uint8)
    for b in batches:
        at = b.column(0).to_numpy().astype(np.uint64) % np.uint64(MAP_BITS)
        np.bitwise_or.at(table, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7))).astype(np.uint8))
    yield pa.RecordBatch.from_arrays([pa.array([0], type=pa.int32()), pa.array([table.tobytes()], type=pa.binary())], ["k", "bits"])


def bit_map(numbers: DataFrame):
    """The broadcast bit map of a column of 64-bit numbers: MAP_BITS bits however many they are, made in eight parts."""
    table = np.zeros(MAP_BITS // 8, dtype=np.uint8)
    for r in numbers.coalesce(8).mapInArrow(_map_part, "k int, bits binary").toLocalIterator():
        table |= np.frombuffer(r["bits"], dtype=np.uint8)
    return numbers.sparkSession.sparkContext.broadcast(table)


def _in_map(bits):
    @F.pandas_udf("boolean")
    def there(x: pd.Series) -> pd.Series:
        at = x.to_numpy(dtype=np.int64).astype(np.uint64) % np.uint64(MAP_BITS)
        return pd.Series((bits.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1)

    return there


def _align(id_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for b in batches:
            held = []
            for text, w, own, n, seeds, at in zip(*(b.column(c).to_pylist() for c in ("text", "words", "own", "n_own", "seeds", "at"))):
                doc, own = words.of(text), np.frombuffer(own, dtype=np.uint8)
                where = places(np.array(seeds, dtype=np.int64), np.array(at), len(own), grams(doc, SEED).astype(np.int64))[1]
                held.append(stretches(np.frombuffer(w, dtype=np.uint64), doc, own, places=where) / n)
            yield pa.RecordBatch.from_arrays([b.column(id_name), b.column("item"), pa.array(held, type=pa.float64())], [id_name, "item", "share"])

    return run


def shares(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """(doc_id, item_id, share): each candidate with the share of the item's own words that its stretches hold."""
    spark = documents.sparkSession
    full, seeds, same = prepared(items, item_id, text)
    docs = documents.select(doc_id, F.col(text).alias("text"))
    kind, item_kind = documents.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    size = full.agg(F.sum(F.size("seeds")).alias("seeds"), F.sum(F.length("words") / 8).alias("words")).first()
    out_type = f"`{doc_id}` {kind}, item {item_kind}, share double"
    if (size["seeds"] or 0) <= broadcast_seeds and (size["words"] or 0) <= 4 * broadcast_seeds:
        it = full.orderBy("item").toArrow()
        grams_, at = ([np.array(x, dtype=t) for x in it.column(c).to_pylist()] for c, t in (("seeds", np.int64), ("at", np.int32)))
        every = np.concatenate([np.unique(x) for x in grams_] or [np.zeros(0, dtype=np.int64)])
        of = np.concatenate([np.full(len(np.unique(x)), k) for k, x in enumerate(grams_)] or [np.zeros(0, dtype=np.int64)]).astype(np.int64)
        order = np.argsort(every, kind="stable")
        value = (
            every[order],
            of[order],
            np.array(it.column("need").to_pylist(), dtype=np.int64),
            it.column("item").to_pylist(),
            [np.frombuffer(w, dtype=np.uint64) for w in it.column("words").to_pylist()],
            [np.frombuffer(w, dtype=np.uint8) for w in it.column("own").to_pylist()],
            it.column("n_own").to_pylist(),
            grams_,
            at,
            it.schema.field("item").type,
        )
        out = docs.mapInArrow(_scan(spark.sparkContext.broadcast(value), doc_id), out_type)
    else:
        hits = docs.mapInArrow(_hits(bit_map(seeds.select("gram")), doc_id), f"`{doc_id}` {kind}, gram long").distinct()
        count = hits.join(seeds, "gram").groupBy(doc_id, "item").agg(F.count("*").alias("n"))
        cand = written(count.join(full.select("item", "need"), "item").where("n >= need").select(doc_id, "item"))
        # the texts of candidates alone are shuffled: a bit map of their ids lets them out of the scan
        there = _in_map(bit_map(cand.select(F.xxhash64(doc_id).alias("h"))))
        texts = docs.where(F.col(doc_id).isNotNull() & F.col("text").isNotNull()).where(there(F.xxhash64(doc_id))).distinct()
        both = cand.join(texts, doc_id).join(full.select("item", "words", "own", "n_own", "seeds", "at"), "item")
        out = both.select(doc_id, "item", "text", "words", "own", "n_own", "seeds", "at").mapInArrow(_align(doc_id), out_type)
    return out.join(same, "item").select(doc_id, F.col("id").alias(item_id), "share")


def found(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", **options) -> DataFrame:
    """(doc_id, item_id) of every document that holds at least LEAK of the item's own words."""
    return shares(documents, items, doc_id, item_id, **options).where(F.col("share") >= LEAK).select(doc_id, item_id).distinct()
