"""Near-duplicate documents by an exact similarity join on word shingles."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.components import components
from quillspark.operators.ngrams import grams
from quillspark.session import written

#: Texts that share a shingle beyond which its pairs are split over tasks.
HOT = 1000


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """(key, class_id, n_links): documents joined by a Jaccard similarity of at least least, directly or through others.

    class_id is the smallest key of the class; n_links counts the texts (not copies) that a document's text
    is linked to. Texts with the same set of shingles are one representative, so copies never pair.
    Prefix filter: shingles are ordered from the rarest, and two sets can only be that similar if the first
    n - ceil(least n) + 1 of each share one. Sets whose lengths differ too much never meet, nor do sets that
    cannot share enough from the place of the common shingle on. All candidates are verified, so no link is lost. Texts shorter
    than a shingle, null and empty ones are classes of their own.
    """
    hashes = T.let(T.words(F.col(text)), lambda w: F.transform(F.array_distinct(grams(w, shingle)), lambda x: F.xxhash64(x)))
    sets = df.select(F.col(key), hashes.alias("s"))
    sets = written(sets.select(key, F.array_sort(F.array_distinct("s")).alias("s")))
    full = sets.where(F.size("s") > 0).withColumn("h", F.sha2(F.array_join(F.transform("s", lambda x: x.cast("string")), ","), 256))
    reps = written(full.groupBy("h").agg(F.min(key).alias("rep"), F.first("s").alias("s")))
    flat = reps.select("rep", F.explode("s").alias("g"))
    df_ = flat.groupBy("g").agg(F.count("*").alias("df"))
    n = F.size("s")
    ranked = flat.join(df_, "g").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("df", "g"))).alias("o"))
    keep = ranked.join(reps.select("rep", "s"), "rep").select("rep", n.alias("n"), F.slice("o", 1, (n - F.ceil(n * least - 1e-9) + 1).cast("int")).alias("p"))
    keyed = keep.select("rep", "n", F.posexplode("p").alias("at", "x")).where("x.df > 1").select("rep", "n", "at", F.col("x.g").alias("g"), F.col("x.df").alias("df"))
    # lengths in steps of the similarity: the longer of two sets is in the step of the shorter or the next
    keyed = written(keyed.withColumn("step", F.floor(F.ln("n") / math.log(1 / least) + 1e-9 if least < 1 else F.col("n")).cast("int")))
    # shingles in the prefixes of very many texts are split: the longer side by a salt, the shorter goes to each part
    parts = F.ceil(F.col("df") / HOT).cast("int")
    long = keyed.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("at").alias("ib"), "g", "step", F.pmod(F.xxhash64("rep"), parts).cast("int").alias("salt"))
    short = keyed.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("at").alias("ia"), "g", F.explode(F.array("step", F.col("step") + 1)).alias("step"), parts.alias("parts"))
    short = short.select("a", "na", "ia", "g", "step", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
    fits = (F.struct("na", "a") < F.struct("nb", "b")) & (F.col("na") >= F.col("nb") * least - 1e-9)
    # the two sets can share no more than this shingle and what follows it in the shorter rest
    enough = 1 + F.least(F.col("ia"), F.col("ib")) + F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) - 1 >= F.ceil(least / (1 + least) * (F.col("na") + F.col("nb")) - 1e-9)
    met = short.join(long, ["g", "step", "salt"]).where(fits & enough)
    cand = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sa, sb = reps.select(F.col("rep").alias("a"), F.col("s").alias("sa")), reps.select(F.col("rep").alias("b"), F.col("s").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    links = written(cand.join(sa, "a").join(sb, "b").where(common >= least * (F.size("sa") + F.size("sb") - common) - 1e-9).select("a", "b"))
    loops = reps.select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    label = components(links.unionByName(loops))
    count = links.select(F.col("a").alias("rep")).unionAll(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("n"))
    of = full.select(key, "h").join(reps.select("h", "rep"), "h").join(label.withColumnRenamed("node", "rep"), "rep").join(count, "rep", "left")
    return sets.select(key).join(of.select(key, "component", "n"), key, "left").select(key, F.coalesce("component", key).alias("class_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"))
