"""One query per operator over its whole table, with checking SQL where SQL can express the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm import alignment, bwt, languages, lattice, minhash, packing, pages, pivots, quality, sitelines, suffixtrees, tiling, toolcalls

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(spark: SparkSession, name: str = "word_bpe_49k.json") -> str:
    """The vocabulary file; set spark.tabloom.tokenizer (for packing) or spark.tabloom.tokenizers (a folder) where executors keep it elsewhere."""
    path = spark.conf.get("spark.tabloom.tokenizer", None) if name == "word_bpe_49k.json" else None
    if path:
        return path
    folder = spark.conf.get("spark.tabloom.tokenizers", None)
    if folder:
        return f"{folder.rstrip('/')}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_curve_packing")
def curve_packing(spark, sf):
    return packing.pack(table(spark, sf, "documents"), tokenizer_path(spark))


WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

REPEATS_SQL = f"""WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
    s AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
    k AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM s),
    r AS (SELECT doc_id, i FROM k WHERE h IN (SELECT h FROM k GROUP BY h HAVING count(*) > 1)),
    g AS (SELECT DISTINCT doc_id, i + j AS p FROM r, (SELECT unnest(range(0, 35)) AS j)),
    a AS (SELECT d.doc_id, t.p, w[t.p] AS x FROM d, unnest(range(1, len(w) + 1)) AS t(p)),
    m AS (SELECT a.doc_id, string_agg(x, ' ' ORDER BY a.p) FILTER (g.p IS NULL) AS kept, count(g.p) AS n FROM a LEFT JOIN g ON g.doc_id = a.doc_id AND g.p = a.p GROUP BY ALL)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM d LEFT JOIN m ON m.doc_id = d.doc_id"""


@query("op2_suffix_trees", REPEATS_SQL)
def suffix_trees(spark, sf):
    return suffixtrees.drop_repeats(table(spark, sf, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


STRINGS_SQL = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
    s AS (SELECT doc_id, unnest(range(0, len(x) // 2 - 49)) AS i, x FROM d WHERE len(x) >= 100),
    k AS (SELECT doc_id, i, hash(substr(x, 2 * i + 1, 100)) AS h, md5_number(substr(x, 2 * i + 1, 100)) AS m FROM s),
    f AS (SELECT h, m, min(doc_id) AS first FROM k GROUP BY ALL),
    r AS (SELECT doc_id, i, i - lag(i, 1, -100) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM k JOIN f USING (h, m) WHERE first < doc_id),
    q AS (SELECT doc_id, i, sum(CASE WHEN gap > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM r),
    p AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM q GROUP BY ALL),
    e AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS z FROM p),
    t AS (SELECT e.doc_id, string_agg(substr(x, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS kept,
        sum(b - a) AS n, count(*) AS c FROM e JOIN d ON d.doc_id = e.doc_id GROUP BY e.doc_id)
    SELECT d.doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(c, 0) AS BIGINT) AS n_spans,
    sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM d LEFT JOIN t ON t.doc_id = d.doc_id"""


@query("op3_column_bwt", STRINGS_SQL)
def column_bwt(spark, sf):
    out = bwt.drop_repeats(table(spark, sf, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op4_string_tiling")
def string_tiling(spark, sf):
    return tiling.leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"), fold=True)


@query("op5_zstd_language")
def zstd_language(spark, sf):
    docs = table(spark, sf, "documents").withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)))
    known = languages.learn_dictionaries(docs.where(~F.col("held_out")))
    return languages.classify(docs, known, keep=("doc_id", "held_out"))


LINES_SQL = r"""WITH d AS (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents),
    x AS (SELECT doc_id, source, t.i, l[t.i] AS line, trim(l[t.i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM d, unnest(range(1, len(l) + 1)) AS t(i)),
    b AS (SELECT bare FROM x WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT source) >= 10),
    k AS (SELECT x.doc_id, string_agg(line, chr(10) ORDER BY i) FILTER (b.bare IS NULL) AS kept, count(*) AS n_lines, count(b.bare) AS n FROM x LEFT JOIN b ON b.bare = x.bare GROUP BY ALL)
    SELECT documents.doc_id, CAST(coalesce(n_lines, 1) AS BIGINT) AS n_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_removed_lines,
    CASE WHEN text IS NOT NULL THEN sha256(coalesce(kept, '')) END AS kept_sha256 FROM documents LEFT JOIN k ON k.doc_id = documents.doc_id"""


@query("op6_site_lines", LINES_SQL)
def site_lines(spark, sf):
    out = sitelines.strip_lines(table(spark, sf, "documents"))
    return out.select("doc_id", "n_lines", "n_removed_lines", F.sha2("text", 256).alias("kept_sha256"))


#: The tables hold no tool calls; calls and results are derived from the turns of every conversation: an assistant turn
#: calls a tool with its whole text, the next user turn is the result, and one in three calls uses the call before it.
TOOLS = {
    "search": {"query": ("string", True), "limit": ("integer", False), "after": ("string", False)},
    "measure": {"limit": ("integer", True), "query": ("string", False), "after": ("string", False)},
    "store": {"query": ("string", True), "limit": ("integer", True), "after": ("string", False), "note": ("string", True)},
}
CALL = "'call_' || conv_id || '_' || {turn}"
NAME = "CASE length(text) % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'measure' ELSE 'store' END"
LIMIT = "CASE WHEN length(text) % 7 = 0 THEN '\"' || length(text) || '\"' ELSE CAST(length(text) AS VARCHAR(20)) END"
#: What the checking SQL holds of an assistant text; the query below passes the whole text on.
QUERY = "substring(text, 1, 20)"
AFTER = "CASE WHEN turn > 2 AND length(text) % 3 = 1 THEN ',\"after\":\"@call_' || conv_id || '_' || (turn - 2) || '\"' ELSE '' END"
NOTE = "CASE WHEN length(text) % 2 = 0 THEN '{sep}\"note\":\"n' || turn || '\"' ELSE '' END"

CALLS_SQL = rf"""WITH c AS (SELECT conv_id, turn, text, {CALL.format(turn="turn")} AS id, {NAME} AS name, to_json({QUERY}) AS q FROM conversations WHERE role = 'assistant'),
    r AS (SELECT conv_id, turn - 1 AS cturn, turn, text AS content FROM conversations WHERE role = 'user' AND turn > 0),
    p AS (SELECT *, turn > 2 AND length(text) % 3 = 1 AS refers, length(text) % 2 = 0 AS noted, length(text) % 7 = 0 AS quoted FROM c),
    u AS (SELECT p.*, r.content, r.turn AS rturn, o.id IS NOT NULL AS held FROM p LEFT JOIN r ON r.conv_id = p.conv_id AND r.cturn = p.turn
        LEFT JOIN p o ON o.conv_id = p.conv_id AND p.refers AND o.turn = p.turn - 2),
    v AS (SELECT *, turn - 2 * coalesce((SELECT max(z.turn) FROM u z WHERE z.conv_id = u.conv_id AND z.turn <= u.turn AND (u.turn - z.turn) % 2 = 0 AND NOT z.held), 0) / 2 AS back FROM u),
    w AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY CAST(back / 2 AS BIGINT), turn, id) AS position,
        list_sort(list_filter([CASE WHEN quoted THEN 'limit: string instead of integer' END, CASE WHEN noted AND name <> 'store' THEN 'note: not a parameter' END,
        CASE WHEN NOT noted AND name = 'store' THEN 'note: missing' END], lambda x: x IS NOT NULL)) AS errors FROM v)
    SELECT conv_id, id AS call_id, turn, name, CAST(position AS BIGINT) AS position, CASE WHEN len(errors) > 0 THEN 'invalid' WHEN rturn IS NULL THEN 'unanswered' ELSE 'ok' END AS status,
    array_to_string(errors, '; ') AS errors, '{{"arguments":{{' || CASE WHEN refers THEN '"after":"@call_' || conv_id || '_' || (turn - 2) || '",' ELSE '' END || '"limit":' ||
    CASE WHEN quoted THEN '"' || length(text) || '"' ELSE CAST(length(text) AS VARCHAR) END || CASE WHEN noted THEN ',"note":"n' || turn || '"' ELSE '' END || ',"query":' || q || '}},"id":"' || id ||
    '","name":"' || name || '"' || CASE WHEN rturn IS NOT NULL THEN ',"result":' || to_json(content) ELSE '' END || '}}' AS json FROM w
    UNION ALL SELECT r.conv_id, 'call_' || r.conv_id || '_' || r.cturn, r.turn, NULL, NULL, 'orphan', '', '{{"id":"call_' || r.conv_id || '_' || r.cturn || '","result":' || to_json(content) || '}}'
    FROM r LEFT JOIN c ON c.conv_id = r.conv_id AND c.turn = r.cturn WHERE c.id IS NULL"""


@query("op7_tool_calls", CALLS_SQL)
def tool_calls(spark, sf):
    turns = table(spark, sf, "conversations")
    text = "regexp_extract(to_json(named_struct('x', text)), '(?s)^.\"x\":(.*).$', 1)"
    calls = turns.where("role = 'assistant'").selectExpr(
        "conv_id", "turn", CALL.format(turn="turn") + " AS call_id", NAME + " AS name",
        f"'{{\"query\": ' || {text} || {NOTE.format(sep=',')} || {AFTER} || ', \"limit\" : ' || {LIMIT} || '}}' AS arguments")
    results = turns.where("role = 'user' AND turn > 0").selectExpr("conv_id", "turn", CALL.format(turn="(turn - 1)") + " AS call_id", "text AS content")
    out = toolcalls.link(calls, results, toolcalls.schema_table(spark, TOOLS))
    return out.withColumn("errors", F.array_join("errors", "; "))


@query("op8_circulant_minhash")
def circulant_minhash(spark, sf):
    return minhash.near_duplicates(table(spark, sf, "documents"), size=3, percent=85).drop("__th")


RULES_SQL = rf"""WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, {WORDS_SQL} AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
    s AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM d WHERE len(w) >= 5),
    k AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 4], ' ')) AS h FROM s),
    r AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) AS c FROM k), (SELECT unnest(range(0, 5)) AS j) WHERE c > 1 GROUP BY doc_id),
    m AS (SELECT d.doc_id, lang, source, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars, len(t) - len(translate(t, '#*$%&|<>', '')) AS n_symbols,
        len(l) - len(list_distinct(l)) AS n_dup_lines, len(l) AS lines, coalesce(n, 0) AS n_repeat_words FROM d LEFT JOIN r ON r.doc_id = d.doc_id),
    b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, n_symbols / greatest(word_chars, 1) AS m1, word_chars / greatest(n_words, 1) AS m2,
        n_dup_lines / greatest(lines, 1) AS m3 FROM m),
    f AS (SELECT doc_id, lang, source, u.k, u.x FROM b, unnest([{{'k': 1, 'x': m1}}, {{'k': 2, 'x': m2}}, {{'k': 3, 'x': m3}}]) AS q(u) WHERE NOT base_failed),
    g AS (SELECT 1 AS level, lang, source, k, x FROM f UNION ALL SELECT 2, lang, NULL, k, x FROM f UNION ALL SELECT 3, NULL, NULL, k, x FROM f),
    o AS (SELECT *, row_number() OVER (PARTITION BY level, lang, source, k ORDER BY x) AS r, count(*) OVER (PARTITION BY level, lang, source, k) AS n FROM g),
    h AS (SELECT level, lang, source, k, any_value(n) AS n, min(x) FILTER (r >= 0.25 * n) AS a, min(x) FILTER (r >= 0.5 * n) AS b, min(x) FILTER (r >= 0.75 * n) AS c FROM o GROUP BY ALL),
    c AS (SELECT h.*, greatest(c + (c - a) * 4.0::DOUBLE, b + CASE k WHEN 1 THEN 0.05::DOUBLE WHEN 2 THEN 4.0::DOUBLE ELSE 0.5::DOUBLE END) AS top FROM h),
    e AS (SELECT x.lang, x.source, x.k, CASE WHEN x.n >= 30 THEN x.top WHEN y.n >= 30 THEN y.top ELSE z.top END AS top FROM c x
        JOIN c y ON y.level = 2 AND y.k = x.k AND y.lang IS NOT DISTINCT FROM x.lang JOIN c z ON z.level = 3 AND z.k = x.k WHERE x.level = 1),
    v AS (SELECT lang, source, max(top) FILTER (k = 1) AS t1, max(top) FILTER (k = 2) AS t2, max(top) FILTER (k = 3) AS t3 FROM e GROUP BY ALL)
    SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
    CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(m1 > t1, false) AND NOT coalesce(m2 > t2, false) AND NOT coalesce(m3 > t3, false) AS kept
    FROM b LEFT JOIN v ON v.lang IS NOT DISTINCT FROM b.lang AND v.source IS NOT DISTINCT FROM b.source"""


@query("op9_quality_rules", RULES_SQL)
def quality_rules(spark, sf):
    out = quality.quality_rules(table(spark, sf, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op10_crf_extraction")
def crf_extraction(spark, sf):
    rows = table(spark, sf, "pages")
    return pages.extract(rows, pages.learn(rows))


@query("op11_token_alignment")
def token_alignment(spark, sf):
    paths = [tokenizer_path(spark, name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken")]
    out = alignment.align(table(spark, sf, "documents"), *paths)
    return out.select("doc_id", *alignment.SUMS, F.when(F.col("n_a") == 0, "").otherwise(F.sha2("groups", 256)).alias("groups_sha256"))


NEAR_VECTORS_SQL = """WITH RECURSIVE g AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM g a, g b WHERE a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
    r(u, v) AS (SELECT u, v FROM l UNION SELECT r.u, l.v FROM r JOIN l ON l.u = r.v),
    n AS (SELECT u, count(*) AS n FROM l GROUP BY u), m AS (SELECT u, min(v) AS least FROM r GROUP BY u)
    SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id, coalesce(vec_id <= least, true) AS kept
    FROM embeddings LEFT JOIN n ON n.u = vec_id LEFT JOIN m ON m.u = vec_id"""


@query("op12_lattice_near_vectors", NEAR_VECTORS_SQL)
def lattice_near_vectors(spark, sf):
    return lattice.near_vectors(table(spark, sf, "embeddings"))


def clusters_sql(rounds: int = pivots.ROUNDS) -> str:
    """One assignment and one mean per round, written out."""
    parts = ["""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, e FROM v QUALIFY c < 8)"]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT vec_id, v.e, c, list_sum(list_transform(list_zip(v.e, k.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v, c{i} k
        QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)""")
        if i < rounds:
            parts.append(f"""s{i} AS (SELECT c, p, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(e) AS x, generate_subscripts(e, 1) AS p FROM a{i}) GROUP BY c, p),
        m{i} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) / n AS BIGINT) ORDER BY p) AS e FROM s{i} GROUP BY c),
        c{i + 1} AS MATERIALIZED (SELECT k.c, coalesce(m.e, k.e) AS e FROM c{i} k LEFT JOIN m{i} m ON m.c = k.c)""")
    return f"""WITH {", ".join(parts)} SELECT vec_id, CAST(a.c AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
    CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(k.e, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} k ON k.c = a.c"""


@query("op13_pivot_clusters", clusters_sql())
def pivot_clusters(spark, sf):
    return pivots.cluster(table(spark, sf, "embeddings"))
