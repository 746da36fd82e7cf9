"""The pipeline's stages against plain versions, each on the rows that its predecessor kept."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
import test_operators as small  # noqa: E402
from tabloom.llm import tiling  # noqa: E402


def test_stages(spark, tmp_path):
    item = small.prose(25)
    rows = [r for r in small.ROWS if r[0] not in (42,)] + [(100 + i, f"{small.prose(30)}\nshared line of the site\n{small.prose(20)}") for i in range(24)]
    rows += [(200, small.prose(40) + " " + item), (201, item + " " + small.prose(60)), (300, None), (301, "")]
    docs = spark.createDataFrame([(k, t, "en", f"s{k % 12}", len(t or "")) for k, t in rows], brute.SCHEMA)
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "line_dedup", "near_duplicates", "decontamination", "packing"]

    def step(name, df):
        out = stages[name](spark, df, folder)
        out.write.parquet(f"{folder}/{name}")
        df = spark.read.parquet(f"{folder}/{name}")
        if name != "packing":
            assert df.columns == list(corpus_pipeline.DOCUMENTS)
        return df, df.collect()

    df, got = step("quality_rules", docs)
    for r in got:
        n, _, _, _, repeated = brute.quality(r.text)
        assert n >= 10 and 100 * repeated <= 20 * n
    assert {k for k, _ in rows if k >= 100 and k < 300} <= {r.doc_id for r in got}
    before = got
    df, got = step("line_dedup", df)
    want = brute.boilerplate([(r.text, r.source) for r in before], 10)
    assert sorted((r.doc_id, r.text, r.n_chars) for r in got) == sorted((r.doc_id, w, len(w)) for r, w in zip(before, want))
    assert not any("shared line" in r.text for r in got)
    before = got
    df, got = step("near_duplicates", df)
    want = brute.groups([(r.doc_id, r.text) for r in before], 5, 80)
    assert sorted(r.doc_id for r in got) == sorted(k for k, (_, c) in want.items() if c == k) and len(got) < len(before)
    before = got
    df, got = step("decontamination", df)
    clean = [r.doc_id for r in before if brute.tiled(r.text, item, tiling.SEED_WORDS)[0] < tiling.COVERAGE * 25]
    assert sorted(r.doc_id for r in got) == sorted(clean) and not {200, 201} & set(clean)
    before = got
    df, got = step("packing", df)
    assert {r.doc_id for r in got} == {r.doc_id for r in before}
    assert corpus_pipeline.run(spark, folder).count() == len(got)
