"""Driver queries of the operators, and DuckDB SQL where it can express them."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, jaccard, middle, mixing, packing, periods, pii, quality, shards, substrings, topk, url_filters
from .shared import scratch

BPE_RANKS = "byte_bpe_multi_50k.tiktoken"
WORD_BPE = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN, digests=True)
    return found.withColumnsRenamed({"ids": "ids_sha256", "decoded": "decoded_sha256"})


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_spans(table(spark, sf_dir, "documents")).drop("row")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.url_verdicts(table(spark, sf_dir, "pages")).drop("trust", "distrust")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as the store's last version holds it, after appends, compaction and vacuum."""
    store = shards.shard_table(table(spark, sf_dir, "documents"), scratch(spark, "shards"))
    return store.read().select("doc_id", "lang", "source", "n_chars", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), lambda v: v % 20 == 0)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = middle.fill_in_middle(table(spark, sf_dir, "documents"))
    back = middle.restored(F.col("form"), F.col("output"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"), "copies")


def echo(doc_id: int | None, words: int) -> tuple[int, int] | None:
    """The contract's repeats: from a word on, with a period, in every tenth document by CRC-32 of its id; no id counts as no digits."""
    g, tenth = divmod(zlib.crc32(b"" if doc_id is None else b"%d" % doc_id), 10)
    a = g % words
    return (a, 1 + (words - a) // (3 + g % 8)) if tenth == 0 else None


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.periodic_runs(table(spark, sf_dir, "documents"), echo=echo)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r.start, F.lit(","), r.length, F.lit(","), r.period, F.lit("\n"))), "")
    found = found.withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length DIV -best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mixture(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_exact_dedup, op2_byte_bpe, op3_substring_dedup, op4_url_filters, op5_best_fit_packing,
            op6_sharding, op7_exact_top_k, op8_jaccard_join, op9_pii, op10_quality_classifier,
            op11_fill_in_middle, op12_periodic_runs, op13_source_mix,
        )
    }


OP1_SQL = r"""
WITH norm AS (
    SELECT doc_id, length(coalesce(text, '')) AS chars,
           regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
    FROM documents
), ranked AS (
    SELECT doc_id, sha256(norm) AS text_sha256,
           first_value(doc_id) OVER w AS keep_id,
           row_number() OVER w AS place,
           count(*) OVER (PARTITION BY norm) AS group_size
    FROM norm
    WINDOW w AS (PARTITION BY norm ORDER BY chars DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM ranked
"""

OP3_SQL = rf"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS l FROM documents WHERE text IS NOT NULL
), based AS (
    SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM lines
), split AS (
    SELECT doc_id, l, base, regexp_extract_all(line, '(\s*)(\S+)', 1) AS gaps, regexp_extract_all(line, '(\s*)(\S+)', 2) AS said FROM based
), words AS (
    SELECT doc_id, l, base, len(said) AS n, unnest(gaps) AS gap, unnest(said) AS word, unnest(range(len(said))) AS k FROM split
), placed AS (
    SELECT doc_id, l, k, n, lower(word) AS word, length(word) AS size, substr(md5(lower(word)), 1, 16) AS key,
           base + sum(length(gap) + length(word)) OVER (PARTITION BY doc_id, l ORDER BY k) AS "end" FROM words
), cut AS (
    SELECT *, k = 0 OR (k >= {substrings.REACH} AND k < n - {substrings.REACH}
        AND key < min(key) OVER (PARTITION BY doc_id, l ORDER BY k ROWS BETWEEN {substrings.REACH} PRECEDING AND 1 PRECEDING)
        AND key <= min(key) OVER (PARTITION BY doc_id, l ORDER BY k ROWS BETWEEN 1 FOLLOWING AND {substrings.REACH} FOLLOWING)) AS starts FROM placed
), numbered AS (
    SELECT *, sum(CAST(starts AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY l, k) AS unit FROM cut
), units AS (
    SELECT doc_id, unit, min("end" - size) AS start, max("end") AS "end", count(*) AS words, string_agg(word, ' ' ORDER BY k) AS said FROM numbered GROUP BY doc_id, unit
), ranked AS (
    SELECT *, first_value(doc_id) OVER w AS first_doc_id, first_value(start) OVER w AS first_start FROM units WINDOW w AS (PARTITION BY said ORDER BY doc_id, start)
), islands AS (
    SELECT *, unit - row_number() OVER (PARTITION BY doc_id ORDER BY unit) AS island FROM ranked WHERE doc_id <> first_doc_id OR start <> first_start
)
SELECT doc_id, CAST(min(start) AS BIGINT) AS start, CAST(max("end") AS BIGINT) AS "end", count(*) AS units, CAST(sum(words) AS BIGINT) AS words,
       arg_min(first_doc_id, unit) AS first_doc_id, CAST(arg_min(first_start, unit) AS BIGINT) AS first_start
FROM islands GROUP BY doc_id, island HAVING sum(words) >= {substrings.LEAST_SPAN}
"""

UPPER, LOWER = url_filters.UPPER, url_filters.LOWER


def _ruling(value: str) -> str:
    """The longest fitting rule of the contract, as SQL."""
    fits = lambda d, p: f"(host = '{d}' OR ends_with(host, '.{d}')) AND starts_with(path, '{p}')"
    by_length = sorted(url_filters.RULES, key=lambda r: -len(r[0] + r[1]))
    return "CASE " + " ".join(f"WHEN {fits(d, p)} THEN '{d + p if value == 'rule' else said}'" for d, p, said in by_length) + " END"


#: Signs before hosts tell trust, along the edges, from distrust, against them. 160 rounds leave 5e-12 of the ranks.
OP4_SQL = rf"""
WITH RECURSIVE parts AS (
    SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS after FROM pages
), named AS (
    SELECT page_id, html, coalesce(translate(regexp_extract(after, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
           coalesce(regexp_extract(after, '(?s)^[^/?#]*([^?#]*)', 1), '') AS path FROM parts
), judged AS (
    SELECT *, {_ruling("rule")} AS rule, {_ruling("verdict")} AS ruling FROM named
), hosts AS (
    SELECT host, avg(CASE WHEN ruling = 'allow' THEN 1.0 ELSE 0.0 END) AS good, avg(CASE WHEN ruling = 'block' THEN 1.0 ELSE 0.0 END) AS bad
    FROM judged WHERE host <> '' GROUP BY host
), linked AS (
    SELECT host AS src, translate(unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']?(?:https?:)?//([^"''/?#>\s]+)', 1)), '{UPPER}', '{LOWER}') AS dst FROM judged
), nodes AS (
    SELECT DISTINCT array_to_string(labels[k:], '.') AS host
    FROM (SELECT labels, unnest(range(1, greatest(len(labels), 2))) AS k FROM (SELECT string_split(host, '.') AS labels FROM hosts WHERE NOT regexp_matches(host, '^[0-9.:]*$')))
), kin AS (
    SELECT host, regexp_replace(host, '^[^.]*\.?', '') AS parent FROM nodes
    WHERE parent <> '' AND (parent IN (SELECT host FROM nodes) OR parent IN (SELECT host FROM hosts))
), edges AS (
    SELECT src, dst FROM linked WHERE src <> '' AND dst <> src UNION SELECT host, parent FROM kin UNION SELECT parent, host FROM kin
), signed AS (
    SELECT '+' || src AS src, '+' || dst AS dst FROM edges UNION ALL SELECT '-' || dst, '-' || src FROM edges
), out AS (
    SELECT src, dst, count(*) OVER (PARTITION BY src) AS degree FROM signed
), seeds AS (
    SELECT host, max(seed) AS seed FROM (
        SELECT '+' || host AS host, good AS seed FROM hosts UNION ALL SELECT '-' || host, bad FROM hosts
        UNION ALL SELECT src, 0.0 FROM signed UNION ALL SELECT dst, 0.0 FROM signed) GROUP BY host
), ranks AS (
    SELECT 0 AS round, host, seed::DOUBLE AS rank FROM seeds
    UNION ALL
    SELECT s.round, seeds.host, 0.15 * seed + 0.85 * coalesce(come, 0) FROM seeds, (SELECT max(round) + 1 AS round FROM ranks) s
    LEFT JOIN (SELECT dst, sum(rank / degree) AS come FROM ranks JOIN out ON src = host GROUP BY dst) c ON c.dst = seeds.host
    WHERE s.round <= 160
), settled AS (
    SELECT substr(host, 2) AS host, max(rank) FILTER (WHERE host LIKE '+%') AS trust, max(rank) FILTER (WHERE host LIKE '-%') AS distrust FROM ranks WHERE round = 160 GROUP BY 1
)
SELECT page_id, host, path, rule, coalesce(ruling, CASE WHEN distrust > trust THEN 'block' ELSE 'allow' END) AS verdict FROM judged LEFT JOIN settled USING (host)
"""

OP8_SQL = rf"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM words WHERE len(w) > 0)
), sets AS (
    SELECT doc_id, count(*) AS n, string_agg(s, '|' ORDER BY s) AS said FROM shingles GROUP BY doc_id
), links AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN sets x ON x.doc_id = a.doc_id JOIN sets y ON y.doc_id = b.doc_id
    GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), reach AS (
    SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
), least AS (
    SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
), classes AS (
    SELECT doc_id, min(doc_id) OVER (PARTITION BY said) AS class_id FROM sets
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(class_id, doc_id) AS class_id, coalesce(component_id, doc_id) AS component_id
FROM documents LEFT JOIN sets USING (doc_id) LEFT JOIN classes USING (doc_id) LEFT JOIN least USING (doc_id)
"""

OP6_SQL = """
SELECT doc_id, lang, source, n_chars, sha256(coalesce(text, '')) AS text_sha256 FROM documents
"""

OP7_SQL = """
WITH v AS (
    SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.own, a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
    FROM v a JOIN v b ON a.own <> b.own AND len(a.q) = len(b.q)
    WHERE a.vec_id % 20 = 0
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


OP11_SQL = r"""
WITH cut AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h,
           regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w FROM documents
), hashed AS (
    SELECT doc_id, text, w, len(w) AS n, ('0x' || h[1:8])::BIGINT % (len(w) + 1) AS one, ('0x' || h[9:16])::BIGINT % (len(w) + 1) AS two,
           ('0x' || h[17:24])::BIGINT % 100 AS cuts, ('0x' || h[25:32])::BIGINT % 100 AS turns FROM cut
), parts AS (
    SELECT doc_id, n, text, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR cuts >= 50 THEN 'plain' WHEN turns < 80 THEN 'spm' ELSE 'psm' END AS form,
           array_to_string(w[1:least(one, two)], '') AS prefix, array_to_string(w[least(one, two) + 1:greatest(one, two)], '') AS middle, array_to_string(w[greatest(one, two) + 1:n], '') AS suffix FROM hashed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256, count(*) OVER (PARTITION BY text) AS copies
FROM parts
"""

#: CRC-32 goes over the bits of the id's digits; words that are equal and a period apart make islands.
OP12_SQL = r"""
WITH said AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
           xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [256 + ord(c), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]))),
               lambda crc, x: CASE WHEN x >= 256 THEN xor(crc, x - 256) WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END)) AS h FROM documents
), echoed AS (
    SELECT doc_id, w, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) ELSE len(w) END AS a, 3 + (h // 10) % 8 AS parts FROM said
), words AS (
    SELECT doc_id, n, i, w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // parts) END] AS word FROM (SELECT *, unnest(range(n)) AS i FROM echoed)
), equal AS (
    SELECT x.doc_id, x.i, y.i - x.i AS p FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND (y.i - x.i) * 4 <= x.n
), stretches AS (
    SELECT doc_id, min(i) AS start, count(*) + p AS length, p FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS island FROM equal) GROUP BY doc_id, p, island
), runs AS (
    SELECT doc_id, start, length, min(p) AS p FROM stretches WHERE length >= greatest(6, 4 * p) GROUP BY doc_id, start, length
), listed AS (
    SELECT doc_id, count(*) AS n_runs, max_by(struct_pack(start := start, length := length, p := p), struct_pack(length := length, s := -start, p := -p)) AS best,
           string_agg(start || ',' || length || ',' || p || chr(10), '' ORDER BY start, p) AS lines FROM runs GROUP BY doc_id
), dropped AS (
    SELECT DISTINCT doc_id, unnest(range(start + p, start + length)) AS i FROM runs
), kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS collapsed FROM words ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(best.start AS BIGINT) AS start, CAST(best.length AS BIGINT) AS length, CAST(best.p AS BIGINT) AS period, CAST(1000 * best.length // best.p AS BIGINT) AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM documents LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

#: Each round stops the sources that the level before would take more than twice.
OP13_SQL = r"""
WITH RECURSIVE sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
           CAST(('0x' || sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, ''))[1:13])::BIGINT AS DOUBLE) / 4503599627370496 AS drawn FROM documents
), sources AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight FROM sized GROUP BY source
), rounds AS (
    SELECT 0 AS round, 1.5::DOUBLE * sum(source_size) / sum(weight) AS level FROM sources
    UNION ALL
    SELECT round + 1, (1.5::DOUBLE * sum(source_size) - sum(CASE WHEN weight * level > 2 * source_size THEN 2.0::DOUBLE * source_size ELSE 0 END)) / sum(CASE WHEN weight * level > 2 * source_size THEN 0 ELSE weight END)
    FROM rounds, sources WHERE round < (SELECT count(*) FROM sources) GROUP BY round, level
), targets AS (
    SELECT source, source_size, least(weight * level, 2 * source_size) AS target FROM sources, (SELECT arg_max(level, round) AS level FROM rounds)
), rates AS (
    SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM targets
)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN drawn < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized JOIN rates ON sized.source IS NOT DISTINCT FROM rates.source
"""


def oracles() -> dict[str, str]:
    return {"op11_fill_in_middle": OP11_SQL, "op12_periodic_runs": OP12_SQL, "op13_source_mix": OP13_SQL, "op1_exact_dedup": OP1_SQL, "op3_substring_dedup": OP3_SQL, "op4_url_filters": OP4_SQL, "op8_jaccard_join": OP8_SQL, "op6_sharding": OP6_SQL, "op7_exact_top_k": OP7_SQL}
