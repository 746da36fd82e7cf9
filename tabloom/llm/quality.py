"""Quality rules: thresholds from mergeable quantile sketches per language and source, then a joined filter.

Only DataFrame functions. A document is measured in place (no rows are exploded, nothing is shuffled but sketches);
each measure's KLL sketch is built per (lang, source), merged upwards to language and corpus, and a group takes its
threshold from the smallest level that holds ``min_rows`` documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import WHITE, only, packed, stored, words

SYMBOLS = "#*$%&|<>"
MEASURES = ("symbol_share", "word_length", "dup_line_share")
#: Up to so many groups (a row of a few doubles each) the thresholds are broadcast; beyond, a hot group's rows are split by the adaptive join.
BROADCAST_GROUPS = 50_000
#: Least distance of a threshold from the median: spread alone says nothing where nearly all documents agree.
SLACK = {"symbol_share": 0.05, "word_length": 4.0, "dup_line_share": 0.5}


def _let(value: str, name: str, body: str) -> str:
    """Bind a value once inside an expression: a repeated subexpression would be worked out for every array element."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


#: Words inside 5-word windows that occur at least twice. Windows are compared by 64-bit hash within one text; only
#: a text in which a hash recurs sorts its windows and adds up the words they cover.
_COVERED = (
    "aggregate({q}, named_struct('last', -5, 'n', 0L), (a, x) -> named_struct('last', x, 'n', a.n + least(5, x - a.last)), a -> a.n)"
)
_RECURRING = _let(
    "sort_array(transform(h, (x, i) -> named_struct('x', x, 'i', i)))", "p",
    _COVERED.format(q="sort_array(array_compact(transform(p, (e, k) -> CASE WHEN e.x = get(p, k - 1).x OR e.x = get(p, k + 1).x THEN e.i END)))"))
REPEAT_WORDS = _let(
    "{words}", "w",
    "CASE WHEN size(w) < 6 THEN 0L ELSE " + _let(
        "transform(sequence(0, size(w) - 5), i -> xxhash64(get(w, i), get(w, i + 1), get(w, i + 2), get(w, i + 3), get(w, i + 4)))", "h",
        "CASE WHEN size(array_distinct(h)) = size(h) THEN 0L ELSE " + _RECURRING + " END") + " END")


def measured(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The kept columns with the base counts and measures of every text (null: no words, all counts 0)."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    df = docs.select(*[F.col(f"`{c}`") for c in keep], body.alias("__body")).withColumn("__words", words(F.col("__body")))
    lines = F.filter(F.split("__body", "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    df = df.select(
        *keep,
        F.size("__words").cast("long").alias("n_words"),
        F.char_length(F.translate("__body", WHITE, "")).cast("long").alias("word_chars"),
        (F.char_length("__body") - F.char_length(F.translate("__body", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0].cast("long").alias("n_dup_lines"),
        F.size(lines).cast("long").alias("__lines"),
        F.expr(REPEAT_WORDS.format(words="__words")).alias("n_repeat_words"))
    ratio = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return df.withColumns({
        "base_failed": (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20),
        "symbol_share": ratio("n_symbols", "word_chars"), "word_length": ratio("word_chars", "n_words"),
        "dup_line_share": ratio("n_dup_lines", "__lines")}).drop("__lines")


def thresholds(rows: DataFrame, groups: tuple[str, str], min_rows: int = 30, sketch_k: int = 1024, fence: float = 4.0) -> DataFrame:
    """One row per group with the upper threshold of every measure: q75 + fence * (q75 - q25), at least SLACK above the median.

    Documents that fail the fixed base rules do not teach the thresholds. Groups without such a document have no row.
    """
    a, b = (F.col(f"`{g}`") for g in groups)
    sk = rows.where(~F.col("base_failed")).groupBy(a.alias("__a"), b.alias("__b")).agg(
        F.count("*").alias("__n"), *[F.kll_sketch_agg_double(m, F.lit(sketch_k)).alias(m) for m in MEASURES])
    merged = lambda *by: sk.groupBy(*by).agg(F.sum("__n").alias("__n"), *[F.kll_merge_agg_double(m, F.lit(sketch_k)).alias(m) for m in MEASURES])
    tag = lambda df, p: df.select(*[F.col(c).alias(f"{p}{c}") for c in df.columns])
    joined = sk.join(tag(merged("__a"), "l"), F.col("__a").eqNullSafe(F.col("l__a"))).join(tag(merged(), "g"), F.lit(True))
    out = [F.col("__a"), F.col("__b")]
    for m in MEASURES:
        own = F.when(F.col("__n") >= min_rows, F.col(m)).when(F.col("l__n") >= min_rows, F.col(f"l{m}")).otherwise(F.col(f"g{m}"))
        q1, q2, q3 = (F.kll_sketch_get_quantile_double(own, F.lit(q)) for q in (0.25, 0.5, 0.75))
        out.append(F.greatest(q3 + (q3 - q1) * fence, q2 + SLACK[m]).alias(f"max_{m}"))
    return joined.select(*out)


def quality_rules(docs: DataFrame, text: str = "text", groups: tuple[str, str] = ("lang", "source"), keep: tuple[str, ...] = ("doc_id",),
                  **how) -> DataFrame:
    """Every row's kept columns, counts, measures, thresholds and ``kept``.

    Null text counts as empty and fails the base rules; null language or source is a group of its own; repeated rows are
    judged alike; an empty table gives an empty result; other columns are ignored. A row whose group taught no threshold
    (all its rows failed the base rules) has failed them itself.
    """
    columns = tuple(dict.fromkeys((*keep, *groups)))
    rows = stored(measured(only(docs, *dict.fromkeys((*columns, text))), text, columns))  # measured once, read twice
    limits = stored(thresholds(rows, groups, **how))
    a, b = (F.col(f"`{g}`") for g in groups)
    if limits.count() <= BROADCAST_GROUPS:
        limits = F.broadcast(limits)
    out = rows.join(limits, a.eqNullSafe(F.col("__a")) & b.eqNullSafe(F.col("__b")), "left").drop("__a", "__b")
    over = F.lit(False)
    for m in MEASURES:
        over = over | F.coalesce(F.col(m) > F.col(f"max_{m}"), F.lit(False))
    return out.withColumn("kept", ~F.col("base_failed") & ~over)


def drop_rejected(docs: DataFrame, text: str = "text", groups: tuple[str, str] = ("lang", "source"), **how) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns, whatever their names; nulls as in :func:`quality_rules`."""
    rows = packed(docs, t=text, a=groups[0], b=groups[1])
    return quality_rules(rows, text="t", groups=("a", "b"), keep=("row",), **how).where("kept").select("row.*")
