"""Line dedup by distinct-site spread: HyperLogLog sketches per line hash, exact counts near the threshold.

Only DataFrame functions. Lines travel as two 64-bit hashes; their text never leaves the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import WHITE, only, stored


def line_hashes(docs: DataFrame, text: str, site: str, *keys: str) -> DataFrame:
    """One row per line with a word: the document's keys, the line's number (__i), two hashes (__a, __b) and its site."""
    bare = lambda x: F.btrim(x, F.lit(WHITE))
    pair = lambda x: F.when(bare(x) != "", F.struct(F.xxhash64(bare(x)).alias("a"), F.xxhash64(F.lit(1), bare(x)).alias("b")))
    df = docs.select(*keys, F.col(f"`{site}`").alias("__site"), F.posexplode(F.transform(F.split(F.col(f"`{text}`"), "\n"), pair)).alias("__i", "__h"))
    return df.where("__h IS NOT NULL").select(*keys, "__site", "__i", F.col("__h.a").alias("__a"), F.col("__h.b").alias("__b"))


def widespread(lines: DataFrame, sites: int, lg_k: int = 12) -> DataFrame:
    """Hashes (__a, __b) of the lines seen on at least ``sites`` distinct sites.

    A sketch's estimate decides only beyond four standard errors of the threshold; lines nearer to it get an exact count.
    """
    error = 4 * 1.04 / (1 << lg_k) ** 0.5
    seen = lines.groupBy("__a", "__b", "__site").agg(F.lit(1).alias("__one"))
    spread = seen.groupBy("__a", "__b").agg(F.hll_sketch_estimate(F.hll_sketch_agg(F.col("__site").cast("string"), F.lit(lg_k))).alias("__n"))
    spread = stored(spread.where(F.col("__n") >= sites * (1 - error) - 0.5))
    clear = F.col("__n") > sites * (1 + error) + 0.5
    near = spread.where(~clear).select("__a", "__b")
    exact = lines.join(near, ["__a", "__b"], "left_semi").groupBy("__a", "__b").agg(F.countDistinct("__site").alias("__n"))
    return spread.where(clear).select("__a", "__b").unionByName(exact.where(F.col("__n") >= sites).select("__a", "__b"))


def strip_lines(docs: DataFrame, sites: int = 10, text: str = "text", site: str = "source", key: str = "doc_id") -> DataFrame:
    """``docs`` with ``text`` rid of lines that stand on at least ``sites`` distinct sites, plus n_lines and n_removed_lines.

    Lines are compared trimmed of white space; blank lines stay; a null site is none. Null text stays null, empty stays
    empty. Rows are told apart by key and text, so repeated rows and null keys are treated alike; extra columns are
    kept, except that n_lines and n_removed_lines are replaced.
    """
    mark = F.xxhash64(F.col(f"`{text}`"))
    slim = only(docs, *dict.fromkeys((key, text, site))).select(F.col(f"`{key}`").alias("__key"), mark.alias("__mark"), F.col(f"`{text}`"), F.col(f"`{site}`"))
    lines = line_hashes(slim, text, site, "__key", "__mark")
    bad = stored(widespread(lines.select("__a", "__b", "__site"), sites))
    hits = lines.select("__key", "__mark", "__i", "__a", "__b").join(bad, ["__a", "__b"])
    flags = hits.groupBy("__key", "__mark").agg(F.sort_array(F.collect_set("__i")).alias("__bad"))
    flags = flags.select(F.col("__key").alias("__k2"), F.col("__mark").alias("__m2"), "__bad")
    body = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed_lines")]).withColumn("__m1", mark)
    df = body.join(flags, F.col(f"`{key}`").eqNullSafe(F.col("__k2")) & (F.col("__m1") == F.col("__m2")), "left")
    # a set difference of line numbers is linear in the lines, unlike a search for each line
    flag = F.expr(f"transform(array(split(`{text}`, '\n')), s -> array_join(transform(array_except(sequence(0, size(s) - 1), __bad), i -> get(s, i)), '\n'))[0]")
    lines_of = F.size(F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), "\n"))
    return df.withColumns({
        text: F.when(F.col("__bad").isNull(), F.col(f"`{text}`")).otherwise(flag),
        "n_lines": lines_of.cast("long"), "n_removed_lines": F.coalesce(F.size("__bad"), F.lit(0)).cast("long"),
    }).drop("__m1", "__m2", "__k2", "__bad")
