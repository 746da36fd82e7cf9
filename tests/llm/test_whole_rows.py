"""Language dictionaries against a plain loop, the registered tiling rule, and filters over tables with awkward columns."""

import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from tabloom.llm import languages, minhash, quality, queries, tiling  # noqa: E402

RNG = random.Random(11)


def prose(n, letters="abcdefghijklmnoprstuvwéñü"):
    return " ".join("".join(RNG.choice(letters) for _ in range(RNG.randint(2, 8))) for _ in range(n))


def texts():
    """Rows (doc_id, text, lang): ties, copies, nulls, a long text, more than 256 languages, a text whose first letter comes late."""
    rows = [(i, prose(30, "abcdef" if i % 2 else "uvwxyz"), "ab" if i % 2 else "uv") for i in range(40)]
    rows += [(40 + i, rows[i][1], rows[i][2]) for i in range(10)] + [(None, rows[0][1], "uv"), (None, None, None)]
    rows += [(100, None, "ab"), (101, "", "ab"), (102, "12 !", "ab"), (103, "7 " * 1500 + prose(20), "late"), (104, prose(8000, "abcdef"), None)]
    return rows + [(1000 + i, f"tongue {prose(4)}", f"l{i:03d}") for i in range(260)]


def test_languages_against_plain_loop(spark):
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("h", F.lit(1)).withColumn("row", F.lit(2))
    for most, size in ((400, 16384), (5, 300)):
        known = languages.learn_dictionaries(df, docs_per_language=most, dictionary_bytes=size)
        assert known == brute.dictionaries([r[1:] for r in rows], most, size)
    assert len(known) > 256 and "late" in known
    some = {x: known[x] for x in ("ab", "uv", "late", "l000", "l001")}
    some["l002"] = some["ab"]  # a tie: the first in order wins
    got = sorted((r.text or "-", r.lang_pred) for r in languages.classify(df, some, keep=("text",)).collect())
    assert got == sorted((t or "-", brute.language(t, some)[0]) for _, t, _ in rows)
    assert languages.learn_dictionaries(df.limit(0)) == {}


def test_language_query(spark, tmp_path):
    rows = texts()
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op5_zstd_language"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(r.held_out is not None and 0 <= r.score <= 1 for r in got)


def test_tiling_as_registered(spark):
    items = [(1, prose(20)), (2, "Übung macht den Meister – sagt „man“"), (3, "two words"), (4, None), (5, "¡!")]
    w = items[0][1].split()
    docs = [prose(15) + " " + items[0][1].upper() + ", " + prose(4), " ".join(w[11:] + w[:11]), " ".join(w[:7]) + " x " + " ".join(w[9:14]), "ÜBUNG, macht: den MEISTER sagt man",
            "x two—WORDS y", " ".join(w[:9]), (items[0][1] + " ") * 30, None, "", "two"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.covered_tokens, r.item_tokens) for r in tiling.leaks(df, bench, fold=True).collect())
    want = []
    for k, t in enumerate(docs):
        for i, x in items:
            covered, n = brute.tiled(t, x, tiling.SEED_WORDS, fold=True)
            if n and covered >= tiling.COVERAGE * n:
                want.append((k, i, covered, n))
    assert got == want and {k for k, *_ in want} >= {0, 1, 2, 3, 4, 6}


def test_filters_with_other_names(spark):
    """Null and repeated keys, clashing columns, another text column, empty tables."""
    item, base = prose(30), prose(60)
    rows = [(1, base), (2, base), (3, prose(40) + " " + item), (4, prose(50)), (None, prose(50)), (None, None), (5, ""), (4, prose(45))]
    df = spark.createDataFrame(rows, "doc_id long, body string")
    for name in ("text", "__k", "__m", "__h", "__th", "__l", "__mark", "row", "k", "t", "m", "h", "a", "b", "l", "kept", "lang", "source"):
        df = df.withColumn(name, F.lit("s"))
    bench = spark.createDataFrame([(1, item)], "item_id long, body string")
    keys = lambda d: sorted((r.doc_id is None, r.doc_id or 0, r.body or "") for r in d.collect())
    every = lambda skip: sorted((k is None, k or 0, t or "") for i, (k, t) in enumerate(rows) if i not in skip)
    near = minhash.drop_near_duplicates(df, text="body")
    assert near.columns == df.columns and keys(near) == every({1})
    left = tiling.drop_leaked(df, bench, text="body", item_text="body", fold=True)
    assert left.columns == df.columns and keys(left) == every({2})
    good = quality.drop_rejected(df, text="body", min_rows=5)
    assert good.columns == df.columns and keys(good) == every({5, 6})
    none = df.limit(0)
    assert not [1 for d in (minhash.drop_near_duplicates(none, text="body"), tiling.drop_leaked(none, bench, text="body", item_text="body"),
                            quality.drop_rejected(none, text="body")) if d.count()]
