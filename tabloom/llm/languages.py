"""Language identification by compression: one raw-content zstandard dictionary per language, smallest size wins."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import only, stored

UNKNOWN = "und"
SLICES = 64


def learn_dictionaries(docs: DataFrame, text: str = "text", lang: str = "lang", docs_per_language: int = 400,
                       dictionary_bytes: int = 16 * 1024) -> dict[str, bytes]:
    """A dictionary per language from a bounded sample: the whole texts of smallest hash, each language's words in ascending frequency.

    The bound is ``docs_per_language`` rows a language; hashes of distinct texts alone are ranked, and each language's
    words are counted by Spark, so only the dictionaries (``dictionary_bytes`` a language) reach the driver. Rows without
    text, letter or language teach nothing; copies of a text are taken once. Any number of languages is learned.
    """
    pool = only(docs, text, lang).where(F.col(f"`{text}`").rlike("\\p{L}") & F.col(f"`{lang}`").isNotNull())
    pool = pool.select(F.col(f"`{lang}`").alias("lang"), F.xxhash64(F.col(f"`{text}`")).alias("h"), F.col(f"`{text}`").alias("t"))
    # the smallest hashes of every slice of a language first: a language with a third of all rows is no single task
    seen = pool.select("lang", "h").distinct().withColumn("slice", F.pmod("h", F.lit(SLICES)))
    few = seen.withColumn("r", F.row_number().over(Window.partitionBy("lang", "slice").orderBy("h"))).where(F.col("r") <= docs_per_language)
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= docs_per_language)
    few = stored(few.select("lang", "h"))  # a table of known size: Spark broadcasts it while it is small
    chosen = pool.join(few, ["lang", "h"]).groupBy("lang", "h").agg(F.min("t").alias("t"))
    counts = chosen.select("lang", F.explode(F.split("t", r"\s+")).alias("w")).where("w <> ''").groupBy("lang", "w").agg(F.count("*").alias("n"))
    # bytes of the words that stand nearer to the end: those that begin within the dictionary's size are kept
    after = Window.partitionBy("lang").orderBy(F.desc("n"), F.desc("w")).rowsBetween(Window.unboundedPreceding, -1)
    near = counts.withColumn("after", F.coalesce(F.sum(F.octet_length("w") + 1).over(after), F.lit(0))).where(F.col("after") < dictionary_bytes)
    words: dict[str, list[tuple[int, str]]] = {}
    for r in near.select("lang", "n", F.expr(f"right(w, {dictionary_bytes})").alias("w")).collect():
        words.setdefault(r.lang, []).append((r.n, r.w))
    return {name: " ".join(w for _, w in sorted(some)).encode()[-dictionary_bytes:] for name, some in sorted(words.items())}


def classify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", keep: tuple[str, ...] = ("doc_id",), chunk_chars: int = 1024,
             margin: float = 0.02, level: int = 6) -> DataFrame:
    """The kept columns with lang_pred, score, margin and ``accepted``.

    The whole text is compressed in pieces of ``chunk_chars`` characters, so that each piece leans on the dictionary
    and not on the text before it; ``und`` for null text and text without a letter. ``score`` is the winner's share when
    languages are weighed by exp(-saved bits); ``accepted`` is false when the winner saves less than ``margin`` of the
    runner-up's size. Ties go to the first language in order; without a dictionary every row is ``und``. Rows are judged one by one: repeated rows alike, other
    columns ignored.
    """
    names = sorted(dictionaries)
    shared = {n: dictionaries[n] for n in names}
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"), F.col(f"`{text}`").rlike("\\p{L}").alias("__letters"))
    kept = [f for f in source.schema.fields if f.name in keep]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["lang_pred string", "score double", "margin double", "accepted boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = []
        for n in names:
            d = zstandard.ZstdCompressionDict(shared[n], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            tools.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
        for batch in batches:
            preds, scores, margins = [], [], []
            for t, letters in zip(batch["__text"], batch["__letters"].to_pylist()):
                if not letters or not names:
                    preds.append(UNKNOWN), scores.append(0.0), margins.append(0.0)
                    continue
                t = t.as_py()
                pieces = [t[i: i + chunk_chars].encode() for i in range(0, len(t), chunk_chars)]
                sizes = [sum(len(tool.compress(p)) for p in pieces) for tool in tools]
                best = min(range(len(sizes)), key=sizes.__getitem__)
                second = min((s for i, s in enumerate(sizes) if i != best), default=None)
                weights = sum(2.0 ** -min(1000, s - sizes[best]) for s in sizes)
                preds.append(names[best]), scores.append(1.0 / weights)
                margins.append(1.0 if second is None else (second - sizes[best]) / second)
            out = [batch[f.name] for f in kept]
            yield pa.RecordBatch.from_arrays(
                [*out, pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64()),
                 pa.array([p != UNKNOWN and m >= margin for p, m in zip(preds, margins)], pa.bool_())],
                names=[f.name for f in kept] + ["lang_pred", "score", "margin", "accepted"])

    return source.mapInArrow(run, schema)
