"""Cutting oversized texts at natural boundaries, with overlap (problem 4).

A text becomes a string of one letter per token that says how strong the boundary
after the token is. Bounded quantifiers over that string then do the cutting: from
each position the regular expression consumes as many letters as the limit allows
and ends at the strongest boundary in the second half of the piece; where there is
none, at the strongest one in the first half, and only a piece without any boundary
ends at any letter (the fallback). The lengths of the matches are the pieces;
each later piece looks back overlap tokens. All of it is built-in SQL functions, so
the cutting stays in the JVM, and single-letter quantifiers run in a loop, so any
limit works without deep recursion.

Results for odd input: null text, null limit, a limit below 1, and texts within the
limit give no pieces from oversized(), and texts within the limit give one piece
from pieces() if whole=True. An overlap that is null or negative counts as 0, one
that reaches the limit as limit - 1. Repeated rows of a text give its pieces once;
of different rows the latest counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import let

#: Characters between tokens.
WS = r" \t\n\r\f"
#: A token with the white space after it; the first takes the white space before it too.
TOKEN = rf"\A[{WS}]*[^{WS}]+[{WS}]*|[^{WS}]+[{WS}]*"
#: Closing marks that may stand after the mark that ends a sentence.
CLOSERS = "\"'”’“‘»«)\\]"
#: A whole token: it starts where no token character stands before it, and never backtracks.
RUN = rf"(?<![^{WS}\x01-\x05])[^{WS}\x01-\x05]++"
#: Boundary letters, strongest first, with the pattern of a token and what follows it.
BOUNDARIES = (
    ("P", rf"{RUN}[ \t\r]*+(?:\f|\n[ \t\r\f]*+\n)[{WS}]*+"),
    ("S", rf"{RUN}(?<=[.!?…][{CLOSERS}]{{0,3}})[{WS}]*+"),
    ("C", rf"{RUN}(?<=[,;:—–][{CLOSERS}]{{0,3}})[{WS}]*+"),
    ("L", rf"{RUN}[ \t\r]*+\n[{WS}]*+"),
    ("W", rf"{RUN}[{WS}]*+"),
)


def boundary_letters(text: Column) -> Column:
    """One letter per token of text: P paragraph, S sentence, C clause, L line, W word."""
    codes = "\x01\x02\x03\x04\x05"
    out = F.translate(text, codes, "xxxxx")
    out = F.regexp_replace(out, rf"\A[{WS}]+", "")
    for code, (_, pattern) in zip(codes, BOUNDARIES):
        out = F.regexp_replace(out, pattern, code)
    return F.translate(out, codes, "".join(x for x, _ in BOUNDARIES))


def _piece_pattern(limit: Column, fresh: Column) -> Column:
    """Alternatives ordered by strength, for the first piece and for those with an overlap before them."""

    def part(most: Column, least: Column) -> Column:
        low, high = F.greatest(least, F.ceil(most / 2).cast("int")).cast("string"), most.cast("string")
        ends = [F.concat(F.lit(".{1,"), high, F.lit("}\\z"))]
        ends += [F.concat(F.lit(".{"), low, F.lit(","), high, F.lit("}(?<=" + x + ")")) for x in "PSCL"]
        ends += [F.concat(F.lit(".{"), F.least(least, most).cast("string"), F.lit(","), high, F.lit("}(?<=" + x + ")")) for x in "PSCL"]
        return F.concat_ws("|", *ends, F.concat(F.lit(".{1,"), high, F.lit("}")))

    # the first piece must hold what the second repeats
    first = part(limit, F.greatest(limit - fresh, F.lit(1)))
    return F.concat(F.lit("\\A(?:"), first, F.lit(")|(?:"), part(fresh, F.lit(1)), F.lit(")"))


def latest(df: DataFrame, key: str, order: str, cols: list[str]) -> DataFrame:
    """One row per key, that of the greatest order value; ties fall to the greatest cols. Null keys are dropped.

    An aggregate with a map-side part, so a key that holds a third of the rows shuffles one row a task.
    """
    picked = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(order, *cols)).alias("_last"))
    return picked.select(key, *[F.col(f"_last.{c}").alias(c) for c in cols])


def pieces(
    texts: DataFrame,
    limits: DataFrame,
    key: str = "text_id",
    text_col: str = "text",
    text_order: str = "received_at",
    limit_col: str = "tokens_per_chunk",
    overlap_col: str = "overlap_tokens",
    limit_order: str = "computed_at",
    whole: bool = False,
    with_text: bool = True,
) -> DataFrame:
    """(key, piece_no from 1, n_pieces, first_token from 0, n_tokens, overlap, piece) of every text over its limit.

    With whole=True also the texts within their limit, as one piece. With with_text=False the
    column piece is left out and only the letters are shuffled, not the texts.
    """
    lettered = texts.select(F.col(key), F.col(text_order), F.col(text_col).alias("_text")).withColumn("_letters", boundary_letters(F.col("_text")))
    now = latest(lettered, key, text_order, ["_letters"] + ["_text"] * with_text)
    lim = latest(limits.select(key, limit_order, limit_col, overlap_col), key, limit_order, [limit_col, overlap_col])
    j = now.join(lim, key).where(F.col("_letters").isNotNull() & (F.col(limit_col) >= 1))
    j = j.where(F.length("_letters") > (F.lit(0) if whole else F.col(limit_col)))
    most = F.col(limit_col).cast("int")
    over = F.least(F.greatest(F.coalesce(F.col(overlap_col).cast("int"), F.lit(0)), F.lit(0)), most - 1)
    j = j.withColumns({"_most": most, "_over": over})
    j = j.withColumn("_sizes", F.transform(F.regexp_extract_all("_letters", _piece_pattern(F.col("_most"), F.col("_most") - F.col("_over")), F.lit(0)), F.length))
    j = j.withColumn("_starts", F.aggregate("_sizes", F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))))
    back = lambda at: F.when(at == 0, 0).otherwise(F.col("_over"))
    span = lambda n, at: F.struct((at - back(at)).alias("first_token"), (n + back(at)).alias("n_tokens"), back(at).alias("overlap"))
    j = j.withColumn("_spans", F.zip_with("_sizes", F.slice("_starts", 1, F.size("_sizes")), span))
    names = ["first_token", "n_tokens", "overlap"]
    if with_text:
        names.append("piece")
        cut = lambda t, p: F.array_join(F.slice(t, p["first_token"] + 1, p["n_tokens"]), "")
        tokens = F.regexp_extract_all("_text", F.lit(TOKEN), F.lit(0))
        j = j.withColumn("_spans", let(tokens, lambda t: F.transform("_spans", lambda p: F.struct(*[p[c].alias(c) for c in names[:3]], cut(t, p).alias("piece")))))
    row = j.select(key, F.size("_spans").alias("n_pieces"), F.posexplode("_spans").alias("_no", "_p"))
    return row.select(key, (F.col("_no") + 1).alias("piece_no"), "n_pieces", *[F.col(f"_p.{c}").alias(c) for c in names])
