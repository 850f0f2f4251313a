"""The registered queries of this subpackage, with their production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, dialogue, html, lines, mih, mixing, quality, rules, secrets, simhash, topk, toxicity, whiten
from lectern.llm.common import crc_mod, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, budget=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.report(secrets.scan(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, 5)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.digests(bpe.encode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup(docs, removed="n_removed")


def op8_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mih.search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, 10)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 3) != 1)
    return quality.score(docs.select("doc_id", "text"), model).select(
        "doc_id",
        (crc_mod("doc_id", 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    return toxicity.score(docs.select("doc_id", "text"), model).select(
        "doc_id",
        (crc_mod("doc_id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "offending",
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(table(spark, sf_dir, "embeddings"))


def op12_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return found.select("doc_id", *rules.MEASURES, "base_failed", "kept")


def op13_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return dialogue.report(turns, dialogue.repair(dialogue.damage(turns)))


QUERIES = {
    "op1_main_text": op1_main_text,
    "op2_mixing": op2_mixing,
    "op3_simhash": op3_simhash,
    "op4_secrets": op4_secrets,
    "op6_byte_bpe": op6_byte_bpe,
    "op5_topk": op5_topk,
    "op7_line_dedup": op7_line_dedup,
    "op8_multi_index": op8_multi_index,
    "op9_quality": op9_quality,
    "op10_toxicity": op10_toxicity,
    "op11_whitening": op11_whitening,
    "op12_rules": op12_rules,
    "op13_dialogue": op13_dialogue,
}

ORACLES: dict[str, str] = {
    # Targets by the level at which sources fill up; multipliers by halving; copies class by class.
    "op2_mixing": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(text, '')) AS mark FROM documents
        ), s AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source
        ), r AS (
            SELECT *, CAST(i % 3 + 1 AS DOUBLE) AS weight, 3.0::DOUBLE * source_size AS bound, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM s
        ), o AS (
            SELECT *, bound / weight AS full_at,
                   (total - coalesce(sum(bound) OVER (ORDER BY bound / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                   / sum(weight) OVER (ORDER BY bound / weight, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r
        ), goal AS (
            -- the level at which the sources that are not full share what the full ones leave
            SELECT source, source_size, least(bound, weight * coalesce((SELECT level FROM o WHERE level <= full_at ORDER BY full_at, i LIMIT 1), 0)) AS target FROM o
        ), h AS (
            SELECT source, CAST(size AS DOUBLE) AS size, count(*) AS n FROM d WHERE size > 0 GROUP BY ALL
        ), halved AS (
            SELECT source, target, least(0, ln(target / source_size)) AS lo, CAST(ln(3) AS DOUBLE) AS hi, 0 AS k FROM goal WHERE source_size > 0
            UNION ALL
            SELECT source, target, CASE WHEN taken < target THEN mid ELSE lo END, CASE WHEN taken < target THEN hi ELSE mid END, k + 1
            FROM (
                SELECT b.source, any_value(target) AS target, any_value(lo) AS lo, any_value(hi) AS hi, any_value(k) AS k, any_value((lo + hi) / 2) AS mid,
                       sum(n * size * least(3, exp(least((lo + hi) / 2 * size, 2)))) AS taken
                FROM halved b JOIN h ON h.source IS NOT DISTINCT FROM b.source WHERE k < 90 GROUP BY b.source
            )
        ), tilt AS (
            SELECT source, CASE WHEN target >= 3 * source_size THEN ln(3) ELSE m END AS m, source_size, target
            FROM goal LEFT JOIN (SELECT source AS s2, lo AS m FROM halved WHERE k = 90) ON s2 IS NOT DISTINCT FROM source
        ), rated AS (
            SELECT doc_id, d.source, size, source_size, target, CASE WHEN size = 0 THEN 0.0 WHEN m * size >= ln(3) THEN 3.0 ELSE round(exp(m * size), 9) END AS rate,
                   md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || size || '|' || mark) AS hash
            FROM d JOIN tilt t ON t.source IS NOT DISTINCT FROM d.source
        ), dealt AS (
            SELECT *, CAST(floor(rate) AS INT) AS whole, rate - floor(rate) AS part, CASE WHEN rate > floor(rate) THEN CAST(floor(log2(size) * 4) AS INT) ELSE -1 END AS class,
                   CAST('0x' || hash[1:8] AS BIGINT) % (SELECT greatest(1, ceil(count(*) / 4000.0)) FROM d)::BIGINT AS bucket
            FROM rated
        ), classes AS (
            SELECT source, class, whole, count(*) AS n, sum(size) AS w, CAST(sum(CAST(part * size AS DECIMAL(38, 10))) AS DOUBLE) AS want,
                   row_number() OVER (PARTITION BY source ORDER BY class DESC, whole DESC) AS i
            FROM dealt WHERE class >= 0 GROUP BY source, class, whole
        ), folded AS (
            SELECT source, class, whole, i, least(greatest(round(want * n / w), 0), n) AS extra, want - least(greatest(round(want * n / w), 0), n) * w / n AS carry FROM classes WHERE i = 1
            UNION ALL
            SELECT c.source, c.class, c.whole, c.i, least(greatest(round((want + carry) * n / w), 0), n), want + carry - least(greatest(round((want + carry) * n / w), 0), n) * w / n
            FROM folded f JOIN classes c ON c.source IS NOT DISTINCT FROM f.source AND c.i = f.i + 1
        ), wide AS (
            SELECT ceil(sqrt(greatest(1, ceil(count(*) / 4000.0))))::BIGINT AS wide FROM d
        ), cells AS (
            SELECT source, class, whole, bucket, bucket // wide AS block, count(*) AS n FROM dealt, wide WHERE class >= 0 GROUP BY ALL
        ), blocks AS (
            SELECT b.*, CAST(extra AS BIGINT) AS extra, sum(n) OVER (g ORDER BY block) AS upto, sum(n) OVER (g) AS every
            FROM (SELECT source, class, whole, block, sum(n)::BIGINT AS n FROM cells GROUP BY ALL) b
            JOIN folded f ON f.source IS NOT DISTINCT FROM b.source AND f.class = b.class AND f.whole = b.whole
            WINDOW g AS (PARTITION BY b.source, b.class, b.whole)
        ), shares AS (
            SELECT c.*, extra * b.upto // b.every - extra * (b.upto - b.n) // b.every AS own, sum(c.n) OVER (g ORDER BY bucket) AS upto, sum(c.n) OVER (g) AS every
            FROM cells c JOIN blocks b ON c.source IS NOT DISTINCT FROM b.source AND c.class = b.class AND c.whole = b.whole AND c.block = b.block
            WINDOW g AS (PARTITION BY c.source, c.class, c.whole, c.block)
        ), placed AS (
            SELECT d.*, coalesce(own * upto // every - own * (upto - n) // every, 0) AS extra,
                   row_number() OVER (PARTITION BY d.source, d.class, d.whole, d.bucket ORDER BY hash, doc_id, size) AS place
            FROM dealt d LEFT JOIN shares s ON s.source IS NOT DISTINCT FROM d.source AND s.class = d.class AND s.whole = d.whole AND s.bucket = d.bucket
        )
        SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST((whole + CASE WHEN place <= extra THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM placed
    """,
    # A run of 50 words that repeats is made of shortest windows of 50 words, forward and backward, that repeat.
    "op7_line_dedup": r"""
        WITH d AS (
            SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents
        ), l AS (
            SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d
        ), w AS (
            SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM l
        ), c AS (
            SELECT *, CAST(sum(n) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS upto FROM w
        ), forward AS (
            SELECT a.doc_id, a.pos AS a, min(b.pos) AS b FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.upto - a.upto + a.n >= 50 GROUP BY ALL
        ), backward AS (
            SELECT b.doc_id, max(a.pos) AS a, b.pos AS b FROM c b JOIN c a ON a.doc_id = b.doc_id AND b.pos >= a.pos AND b.upto - a.upto + a.n >= 50 GROUP BY b.doc_id, b.pos
        ), windows AS (
            SELECT DISTINCT v.doc_id, a, b, md5(array_to_string(list_slice(ls, a, b), chr(10))) AS h
            FROM (SELECT * FROM forward UNION ALL SELECT * FROM backward) v JOIN d ON d.doc_id = v.doc_id
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY h, b - a ORDER BY doc_id, a) AS k FROM windows
        ), gone AS (
            SELECT DISTINCT doc_id, unnest(generate_series(a, b)) AS pos FROM ranked WHERE k > 1
        ), rest AS (
            SELECT w.doc_id, coalesce(string_agg(w.line, chr(10) ORDER BY w.pos) FILTER (WHERE g.pos IS NULL), '') AS text, count(g.pos) AS n_removed
            FROM w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.pos = w.pos GROUP BY w.doc_id
        )
        SELECT doc_id, text, n_removed FROM rest
    """,
    "op5_topk": """
        WITH e AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
            FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
    """,
    # Sketches are counts of rates by their leading bits, so that they and all that follows have exact values here too.
    "op12_rules": r"""
        WITH t AS (
            SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents
        ), w AS (
            SELECT rid, doc_id, lang, source, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
                   list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t
        ), g AS (
            SELECT rid, i, array_to_string(ws[i:i + 4], ' ') AS gram FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)
        ), twice AS (
            SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM g) WHERE c > 1
        ), covered AS (
            SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY rid
        ), m AS (
            SELECT w.rid, doc_id, lang, source, len(ws) AS n_words, coalesce(len(array_to_string(ws, '')), 0) AS word_chars, n_symbols, len(ls) AS n_lines,
                   len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words FROM w LEFT JOIN covered c ON c.rid = w.rid
        ), r AS (
            SELECT rid, doc_id, lang, source, rule, size, CASE WHEN size > 0 THEN 10000 * top // size END AS v
            FROM (SELECT m.*, unnest([{'rule': 'word_length', 'top': word_chars, 'size': n_words}, {'rule': 'symbols', 'top': n_symbols, 'size': n_words},
                                      {'rule': 'repeats', 'top': n_repeat_words, 'size': n_words}, {'rule': 'dup_lines', 'top': n_dup_lines, 'size': n_lines}], recursive := true) FROM m)
        ), b AS (
            SELECT *, (v >> CAST(greatest(0, len(bin(v)) - 7) AS BIGINT)) << CAST(greatest(0, len(bin(v)) - 7) AS BIGINT) AS bucket FROM r WHERE v IS NOT NULL
        ), q AS (
            SELECT 2 AS level, lang, source, rule, bucket, count(*) AS n FROM b GROUP BY ALL
            UNION ALL SELECT 1, lang, NULL, rule, bucket, count(*) FROM b GROUP BY ALL
            UNION ALL SELECT 0, NULL, NULL, rule, bucket, count(*) FROM b GROUP BY ALL
        ), u AS (
            SELECT *, sum(n) OVER (PARTITION BY level, lang, source, rule ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY level, lang, source, rule) AS docs FROM q
        ), k AS (
            SELECT level, lang, source, rule, max(docs) AS docs, min(bucket) FILTER (WHERE 4 * upto >= docs) AS low, min(bucket) FILTER (WHERE 4 * upto >= 3 * docs) AS high FROM u GROUP BY ALL
        ), f AS (
            SELECT a.lang, a.source, a.rule, CASE WHEN a.docs >= 100 THEN a.low WHEN l.docs >= 100 THEN l.low ELSE e.low END AS low,
                   CASE WHEN a.docs >= 100 THEN a.high WHEN l.docs >= 100 THEN l.high ELSE e.high END AS high
            FROM k a JOIN k l ON l.level = 1 AND l.rule = a.rule AND l.lang IS NOT DISTINCT FROM a.lang JOIN k e ON e.level = 0 AND e.rule = a.rule WHERE a.level = 2
        ), x AS (
            SELECT rid, r.rule, size, v - (high + 3 * (high - low)) AS above, CASE WHEN r.rule = 'word_length' THEN low - 3 * (high - low) - v ELSE 0 END AS below,
                   CASE r.rule WHEN 'word_length' THEN 100000 WHEN 'symbols' THEN 10000 WHEN 'repeats' THEN 40000 ELSE 15000 END::BIGINT AS noise
            FROM r JOIN f ON f.rule = r.rule AND f.lang IS NOT DISTINCT FROM r.lang AND f.source IS NOT DISTINCT FROM r.source WHERE v IS NOT NULL
        ), bad AS (
            SELECT DISTINCT rid FROM x WHERE (above > 0 AND above * above * size > noise * noise) OR (below > 0 AND below * below * size > noise * noise)
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
               NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND bad.rid IS NULL AS kept
        FROM m LEFT JOIN bad ON bad.rid = m.rid
    """,
    # Backwards over the turns with the cheapest repair, its audit and its text for each role before the turn.
    "op13_dialogue": r"""
        WITH RECURSIVE named AS (
            SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS g, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations
        ), bits AS (
            SELECT *, list_transform(range(8 * len(name)), lambda i: CAST((ascii(name[i // 8 + 1]) >> CAST(i % 8 AS INT)) & 1 AS BIGINT)) AS bits FROM named
        ), kinds AS (
            SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, bits), lambda c, b: xor(c >> 1, CASE WHEN (c & 1) <> b THEN 3988292384::BIGINT ELSE 0::BIGINT END)), 4294967295::BIGINT) % 20 AS kind FROM bits
        ), hurt AS (
            SELECT g, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM kinds WHERE kind <> 0
        ), o AS (
            SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text, copy) AS i, left(role, 1) AS c FROM hurt
        ), p AS (
            SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 AS again,
                   NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS open, lag(c) OVER (PARTITION BY g ORDER BY i) AS before FROM o
        ), n AS (
            SELECT *, blank OR again AS forced, CASE WHEN open THEN 5 ELSE 0 END AS extra FROM p
        ), f AS (
            SELECT g, CAST(max(i) + 1 AS BIGINT) AS i, {'c': 0::BIGINT, 'a': '', 'x': []::VARCHAR[]} AS f0, {'c': 10::BIGINT, 'a': 'II', 'x': ['user:', 'assistant:']} AS fs,
                   {'c': 5::BIGINT, 'a': 'I', 'x': ['assistant:']} AS fu, {'c': 0::BIGINT, 'a': '', 'x': []::VARCHAR[]} AS fa FROM n GROUP BY g
            UNION ALL
            SELECT g, i, list_min([d0, s, u, ia]), list_min([ds, u, ia]), list_min([du, a, iu]), list_min([da, u, ia])
            FROM (
                SELECT *, CASE WHEN u IS NOT NULL THEN {'c': u.c + 5, 'a': 'I' || u.a, 'x': list_prepend('assistant:', u.x)} END AS iu,
                       CASE WHEN a IS NOT NULL THEN {'c': a.c + 5, 'a': 'I' || a.a, 'x': list_prepend('user:', a.x)} END AS ia
                FROM (
                    SELECT f.g, CAST(n.i AS BIGINT) AS i,
                           {'c': f0.c + 2, 'a': 'D' || f0.a, 'x': f0.x} AS d0, {'c': fs.c + 2, 'a': 'D' || fs.a, 'x': fs.x} AS ds,
                           {'c': fu.c + 2, 'a': 'D' || fu.a, 'x': fu.x} AS du, {'c': fa.c + 2, 'a': 'D' || fa.a, 'x': fa.x} AS da,
                           CASE WHEN NOT forced AND c = 's' THEN {'c': fs.c + extra, 'a': 'K' || fs.a, 'x': list_prepend(role || ':' || text, fs.x)} END AS s,
                           CASE WHEN NOT forced AND c = 'u' THEN {'c': fu.c + extra, 'a': 'K' || fu.a, 'x': list_prepend(role || ':' || text, fu.x)}
                                WHEN NOT forced THEN {'c': fu.c + extra + 1, 'a': 'R' || fu.a, 'x': list_prepend('user:' || text, fu.x)} END AS u,
                           CASE WHEN NOT forced AND c = 'a' THEN {'c': fa.c + extra, 'a': 'K' || fa.a, 'x': list_prepend(role || ':' || text, fa.x)}
                                WHEN NOT forced THEN {'c': fa.c + extra + 1, 'a': 'R' || fa.a, 'x': list_prepend('assistant:' || text, fa.x)} END AS a
                    FROM f JOIN n ON n.g = f.g AND n.i = f.i - 1
                )
            )
        ), counts AS (
            SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE NOT blank AND again) AS duplicate,
                   count(*) FILTER (WHERE NOT forced AND open) AS truncated, count(*) FILTER (WHERE i > 1 AND before || c NOT IN ('su', 'ua', 'au')) AS illegal FROM n GROUP BY g
        )
        SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               coalesce(f0.c, 0) AS cost, coalesce(f0.a, '') AS audit, sha256(coalesce(array_to_string(f0.x, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT g, conv_id FROM named) k LEFT JOIN counts ON counts.g = k.g LEFT JOIN f ON f.g = k.g AND f.i = 1
    """,
}
