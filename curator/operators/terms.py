"""Lexicons as tables: which terms are in which text, by words and by an index of the terms' first characters.

`functions.lexicon` compiles a test for each keyword into the plan, which is fastest for a few hundred of them. Here the
lexicon is a table that may change without a new plan. A term of letters and digits alone stands inside one run of such
characters: terms of the most frequent runs are looked for once, texts meet these runs in a broadcast join, and other runs
are looked through. So are pieces of texts for other terms: the different groups of a few characters in a piece
meet terms that begin with one in a join with the broadcast lexicon; only those terms are looked for in the piece. A
lexicon too large for that meets windows that begin at each character. The cost is that of the texts' length plus what
begins alike, and not that of texts times terms; only a few hundred terms are looked for one by one in whole texts, which
is faster than to take those apart. Texts are dealt by their key first, so that what is found isn't shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..sources.scratch import written

#: First characters that texts and terms meet by (as many of these as a term has), and characters of a text that are taken apart at a time.
HEADS = (1, 2, 4, 6)
HEAD = HEADS[-1]
PIECE = 1024
#: Bytes of terms, with what goes with them, up to which a lexicon is broadcast.
BROADCAST = 8 << 20
#: What runs consist of.
RUN = "[A-Za-z0-9]"
#: Runs whose terms are found beforehand, at most, and of how many texts one is asked which runs are frequent.
KNOWN, SHARE = 100_000, 16
#: Terms up to which each is looked for in each text.
FEW = 300


def indexed(lexicon: DataFrame, term: str = "term") -> DataFrame:
    """lexicon without null and empty terms, and head, the first characters of a term."""
    size = F.lit(HEADS[0])
    for n in HEADS[1:]:
        size = F.when(F.length(term) >= n, n).otherwise(size)
    return lexicon.where(F.length(term) > 0).withColumn("head", F.left(F.col(term), size))


def terms_found(items: DataFrame, lexicon: DataFrame, key: str = "id", text: str = "text", term: str = "term", by: tuple[str, ...] = ()) -> DataFrame:
    """(key, *by, term): the distinct terms of a lexicon in each text, as plain substrings, case-sensitive. `by` are further columns of the lexicon.

    Texts of rows that share a key count together; null and empty texts have none, nor has an empty lexicon. Windows, which a
    lexicon of more than BROADCAST bytes shuffles for each character, are as wide as the longest term. The terms and the frequent runs
    are written to the shared folder.
    """
    own = indexed(lexicon.select(*by, term), term).distinct().select(*[F.col(c).alias(f"_by_{i}") for i, c in enumerate(by)], F.col(term).alias("_term"), "head")
    own = own.withColumn("_in_run", F.regexp("_term", F.lit(rf"\A{RUN}+\z")))
    sizes = own.agg(
        F.max(F.length("_term")).alias("longest"), F.min(F.when(F.col("_in_run"), F.length("_term"))).alias("least"), F.collect_set(F.length("head")).alias("heads"), F.sum(_bytes(own)).alias("bytes"),
        F.count(F.lit(1)).alias("n"), F.count_if("_in_run").alias("in_runs"),
    ).first()
    texts = items.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where(F.length("_text") > 0)
    found = ["_key", *[f"_by_{i}" for i in range(len(by))], "_term"]
    if (sizes["bytes"] or 0) > BROADCAST:
        hits = _in_windows(texts, own, sizes).select(found).distinct()
    elif sizes["n"] <= FEW:
        hits = texts.join(F.broadcast(own), F.contains("_text", "_term")).select(found).distinct()
    else:
        own = written(own.withColumn("_id", F.monotonically_increasing_id()))
        dealt = texts.repartition(_tasks(items), "_key")
        parts = []
        if sizes["in_runs"]:
            inside, known = own.where("_in_run"), _known_runs(texts, own, sizes)
            parts.append(_runs(dealt, sizes).join(F.broadcast(known), "_text").select("_key", F.explode("_ids").alias("_id")))
            parts.append(_in_pieces(_runs(dealt, sizes).join(F.broadcast(known), "_text", "left_anti"), inside, sizes))
        if sizes["in_runs"] < sizes["n"]:
            parts.append(_in_pieces(dealt, own.where("NOT _in_run"), sizes))
        # parts are dealt by key, so each is made distinct where it is
        each = reduce(DataFrame.unionByName, [p.distinct() for p in parts])
        hits = each.distinct().join(F.broadcast(own), "_id")
    return hits.select(F.col("_key").alias(key), *[F.col(f"_by_{i}").alias(c) for i, c in enumerate(by)], F.col("_term").alias(term))


def _bytes(df: DataFrame) -> Column:
    """What a row may take when it is broadcast."""
    return sum((F.coalesce(F.octet_length(c if kind == "binary" else F.col(c).cast("string")), F.lit(0)) for c, kind in df.dtypes), F.lit(64))


def _tasks(items: DataFrame) -> int:
    return max(items.sparkSession.sparkContext.defaultParallelism, 4 * items.rdd.getNumPartitions())


def _runs(texts: DataFrame, sizes: Row) -> DataFrame:
    """(_key, _text) of the different runs of each text that are long enough for a term."""
    return texts.select("_key", F.explode(F.array_distinct(F.regexp_extract_all("_text", F.lit(f"({RUN}{{{sizes['least']},}})"), F.lit(1)))).alias("_text"))


def _known_runs(texts: DataFrame, own: DataFrame, sizes: Row) -> DataFrame:
    """(_text, _ids): the terms in each of the KNOWN runs that most texts have, as told from one text in SHARE. Which they are changes the cost alone."""
    some = _runs(texts.where(F.pmod(F.xxhash64("_text"), F.lit(SHARE)) == 0), sizes).groupBy("_text").count()
    most = written(some.orderBy(F.desc("count"), "_text").limit(KNOWN).select("_text"))
    held = _in_pieces(most.select(F.col("_text").alias("_key"), "_text"), own.where("_in_run"), sizes).groupBy(F.col("_key").alias("_text")).agg(F.collect_set("_id").alias("_ids"))
    return written(most.join(held, "_text", "left").select("_text", F.coalesce("_ids", F.array().cast("array<bigint>")).alias("_ids")))


def _in_pieces(texts: DataFrame, own: DataFrame, sizes: Row) -> DataFrame:
    """(_key, _id) of the terms in texts; a term may come several times."""
    pieces = _pieces(texts, sizes)
    groups = [F.array_distinct(F.regexp_extract_all("_piece", F.lit(rf"(?s)(?=(.{{{n}}}))."), F.lit(1))) for n in sorted(sizes["heads"])]
    keyed = pieces.select("_key", "_piece", F.explode(F.concat(*groups)).alias("head"))
    return keyed.join(F.broadcast(own), "head").where(F.contains("_piece", "_term")).select("_key", "_id")


def _in_windows(texts: DataFrame, own: DataFrame, sizes: Row) -> DataFrame:
    """Rows of texts with each term that begins at one of their characters."""
    windows = _pieces(texts, sizes).select("_key", F.explode(F.regexp_extract_all("_piece", F.lit(rf"(?s)(?=(.{{1,{sizes['longest']}}}))."), F.lit(1))).alias("_window"))
    heads = [F.left(F.col("_window"), F.lit(n)) for n in sorted(sizes["heads"])]
    keyed = windows.select("_key", "_window", F.explode(F.array(*heads)).alias("head"))
    return keyed.join(own, "head").where(F.startswith("_window", "_term"))


def _pieces(texts: DataFrame, sizes: Row) -> DataFrame:
    return texts.select("_key", F.explode(F.regexp_extract_all("_text", F.lit(rf"(?s)(?=(.{{1,{PIECE + sizes['longest'] - 1}}})).{{1,{PIECE}}}"), F.lit(1))).alias("_piece"))


def term_counts(found: DataFrame, key: str = "id", group: str = "criterion", score: str = "score") -> DataFrame:
    """(key, group, n, best) of terms_found by (group, score): how many different terms of a group a text has, and the highest score of them."""
    return found.groupBy(key, group).agg(F.count_distinct("term").alias("n"), F.max(score).alias("best"))
