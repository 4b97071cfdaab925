"""One named query per operator of this package, over the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import op1_urls, op10_quality, op11_extract, op12_centroids, op13_variants, op2_tokens, op3_substrings, op4_mix, op5_jaccard, op6_rules, op7_lines, op8_decontaminate, op9_lattice


TOKENIZER, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; executors need none."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return op1_urls.filter_urls(table(spark, sf, "pages")).drop("url")


def op2_token_output(spark: SparkSession, sf: str) -> DataFrame:
    tokens = op2_tokens.token_output(table(spark, sf, "documents"), tokenizer_path(TOKENIZER))
    return tokens.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    cut = op3_substrings.dedup_substrings(table(spark, sf, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    drawn = op4_mix.with_draws(table(spark, sf, "documents").select("doc_id", "source", "text"))
    return drawn.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).cast("long").alias("taken"))


def op5_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return op5_jaccard.jaccard_components(table(spark, sf, "documents")).drop("uid", "label")


def op6_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "text")
    rated = op6_rules.quality_rules(docs)
    return rated.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    cut = op7_lines.dedup_lines(table(spark, sf, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_decontaminate_benchmark(spark: SparkSession, sf: str) -> DataFrame:
    return op8_decontaminate.decontaminate(table(spark, sf, "documents"), table(spark, sf, "benchmark")).drop("_key")


def op9_lm_score(spark: SparkSession, sf: str) -> DataFrame:
    return op9_lattice.lm_scores(table(spark, sf, "documents").select("doc_id", "text"), tokenizer_path(PIECES))


def op10_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    return op10_quality.quality_scores(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels"))


def op11_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return op11_extract.extract(table(spark, sf, "pages"))


def op12_centroid_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return op12_centroids.cluster(table(spark, sf, "embeddings")).drop("centroid")


def op13_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    return op13_variants.spelling_variants(table(spark, sf, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_url_filter, op2_token_output, op3_substring_dedup, op4_mix_sources, op5_jaccard_join, op6_quality_rules, op7_line_dedup, op8_decontaminate_benchmark, op9_lm_score, op10_quality_classifier, op11_html_extraction, op12_centroid_clusters, op13_spelling_variants)
}

def clusters_sql(k: int = 8, rounds: int = 10, size: int = 64) -> str:
    """The same k-means with every round written out, all distances compared."""
    steps = [f"""
        vectors AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x
            FROM embeddings WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: isfinite(x))) = {size}),
        entries AS MATERIALIZED (SELECT r, unnest(range({size})) AS pos, unnest(x) AS v FROM vectors),
        c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(vec_id::VARCHAR, '')), x) - 1 AS c, x
            FROM vectors QUALIFY c < {k})"""]
    for i in range(rounds + 1):
        steps.append(f"""
        a{i} AS MATERIALIZED (
            SELECT r, min(struct_pack(d := d, c := c)) AS best FROM (
                SELECT r, c, list_sum(list_transform(list_zip(vectors.x, c{i}.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
                FROM vectors, c{i}) GROUP BY r)""")
        if i < rounds:
            steps.append(f"""
        s{i} AS (SELECT best.c AS c, pos, sum(v) AS s, count(*) AS n FROM a{i} JOIN entries USING (r) GROUP BY ALL),
        m{i} AS (SELECT c, list((s - (((s % n) + n) % n)) // n ORDER BY pos)::BIGINT[] AS x FROM s{i} GROUP BY c),
        c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(m{i}.x, c{i}.x) AS x FROM c{i} LEFT JOIN m{i} ON m{i}.c = c{i}.c)""")
    return f"""WITH {",".join(steps)}
        SELECT vec_id, best.c::INTEGER AS cluster, best.d AS distance,
            (sum(best.d) OVER (PARTITION BY best.c))::BIGINT AS cluster_inertia, (sum(best.d) OVER ())::BIGINT AS inertia,
            sha256(array_to_string(c{rounds}.x, ',')) AS centroid_sha256
        FROM a{rounds} JOIN vectors USING (r) JOIN c{rounds} ON c{rounds}.c = best.c"""


#: The given pages mark their article and hold paragraphs and headings with few character references.
ARTICLES = r"""
    WITH bodies AS (
        SELECT page_id, url, string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '</?(p|h1)>') AS parts
        FROM pages),
    blocks AS (
        SELECT page_id, url, list_transform(parts, lambda x: trim(regexp_replace(regexp_replace(replace(replace(replace(regexp_replace(
            x, '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS parts
        FROM bodies),
    texts AS (SELECT page_id, url, array_to_string(list_filter(parts, lambda x: x <> ''), chr(10)) AS text FROM blocks)
    SELECT page_id, url, text, length(text) AS n_chars FROM texts"""

#: Words one edit apart by joins on what is left of them without a letter.
VARIANTS = r"""
    WITH RECURSIVE
    crc AS MATERIALIZED (
        SELECT list(list_reduce(list_prepend(i, range(8)),
            lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS entries
        FROM range(256) t(i)),
    raw AS (
        SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
    runs AS (
        SELECT coalesce(doc_id::VARCHAR, '') || ':' || low AS hashed, low, count(*) AS times
        FROM (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM raw)
        WHERE length(low) >= 7 GROUP BY ALL),
    hashes AS (
        SELECT low, times, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(hashed, ''),
            lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch)::BIGINT]
                ELSE [192 + (unicode(ch) >> 6)::BIGINT, 128 + (unicode(ch) & 63)::BIGINT] END))),
            lambda c, b: xor(entries[(xor(c, b) & 255) + 1], c >> 8))) AS h
        FROM runs, crc),
    results AS (
        SELECT CASE WHEN h % 31 = 0 THEN left(low, (h % length(low))::BIGINT) || substr(low, (h % length(low))::BIGINT + 2) ELSE low END AS word, times
        FROM hashes),
    words AS MATERIALIZED (
        SELECT word, sum(times)::BIGINT AS n FROM results WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
    places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
    holes AS MATERIALIZED (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS less FROM places),
    pairs AS (
        SELECT a.word, b.word AS near, b.n AS near_n FROM holes a JOIN holes b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
        UNION SELECT holes.word, words.word, words.n FROM holes JOIN words ON words.word = less
        UNION SELECT words.word, holes.word, holes.n FROM holes JOIN words ON words.word = less),
    best AS (
        SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
    formed AS MATERIALIZED (
        SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * n THEN near END AS form,
            CASE WHEN near_n >= 10 * n THEN near_n END AS form_n
        FROM words LEFT JOIN best USING (word)),
    chains AS (
        SELECT word, coalesce(form, word) AS root FROM formed
        UNION ALL SELECT chains.word, formed.form FROM chains JOIN formed ON formed.word = chains.root AND formed.form IS NOT NULL),
    ends AS (SELECT chains.word, chains.root FROM chains JOIN formed ON formed.word = chains.root AND formed.form IS NULL)
    SELECT word, form, root, n, n_near, form_n FROM formed JOIN ends USING (word)"""

ORACLE: dict[str, str] = {"op13_spelling_variants": VARIANTS, "op11_html_extraction": ARTICLES, "op12_centroid_clusters": clusters_sql()}
