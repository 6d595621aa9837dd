"""The operators' registered queries, over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, chat, exact_dedup, jaccard_join, line_dedup, mixing, near_dup, packing, quality, resampling, shards, toxicity, warc
from .common import read
from .tokens import tokenizer_path

Query = Callable[[SparkSession, str], DataFrame]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix to target weights takes of each document."""
    return mixing.Mix(read(spark, sf_dir, "documents")).report()


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of texts, blanks evened out."""
    return exact_dedup.mark_copies(read(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to archives and read back."""
    return warc.round_trip(spark, read(spark, sf_dir, "pages"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality measures and verdicts of the documents."""
    return quality.judge(read(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token pieces of the documents in sequences of 4096."""
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path())


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 16 shards of near equal bytes."""
    placed = shards.assign_shards(read(spark, sf_dir, "documents"), 16)
    return placed.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal conversations in chat markup."""
    return chat.render(read(spark, sf_dir, "conversations"))


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents."""
    return near_dup.near_groups(read(spark, sf_dir, "documents"), per_cent=85)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of the documents."""
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier line equals or is one word away from."""
    return line_dedup.drop_lines(read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word n-grams are alike."""
    return jaccard_join.similar_groups(read(spark, sf_dir, "documents"), size=3, per_cent=90)


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings in 16 clusters after three rounds."""
    return centroids.cluster(read(spark, sf_dir, "embeddings"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn to look like the benchmark."""
    return resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {
    "op1_mixing": op1_mixing,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_warc": op3_warc,
    "op4_quality": op4_quality,
    "op5_packing": op5_packing,
    "op6_shards": op6_shards,
    "op7_chat": op7_chat,
    "op8_near_dup": op8_near_dup,
    "op9_toxicity": op9_toxicity,
    "op10_line_dedup": op10_line_dedup,
    "op11_jaccard_join": op11_jaccard_join,
    "op12_centroids": op12_centroids,
    "op13_resampling": op13_resampling,
}


def _rounds_sql(rounds: int) -> str:
    """Assignments and centroids of each round, one after the other."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
        d{i} AS MATERIALIZED (SELECT r, c, sum((x - m) * (x - m))::BIGINT AS dist FROM v JOIN m{i} USING (j) GROUP BY r, c),
        a{i} AS MATERIALIZED (SELECT r, arg_min(c, (dist, c)) AS c, min(dist) AS dist FROM d{i} GROUP BY r)""")
        if i < rounds:
            steps.append(f"""
        m{i + 1} AS MATERIALIZED (SELECT m{i}.c, m{i}.j, coalesce((s - ((s % n) + n) % n) // n, m) AS m FROM m{i} LEFT JOIN (
            SELECT c, j, sum(x)::BIGINT AS s, count(*) AS n FROM v JOIN a{i} USING (r) GROUP BY c, j) USING (c, j))""")
    return ",".join(steps)

ORACLE: dict[str, str] = {
    "op2_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY n) AS keep_id, count(*) OVER (PARTITION BY n) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY n) AS kept, sha256(n) AS text_sha256
        FROM t""",
    "op3_warc": """
        WITH t AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
        d AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM t),
        b AS (SELECT *, list_transform(range(8), lambda i: ('0x' || substr(x, 5 * i + 1, 5))::INT) AS v FROM d)
        SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
               list_aggregate(list_transform(v, lambda n: list_aggregate(list_transform([15, 10, 5, 0],
                   lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((n >> s) & 31) + 1, 1)), 'string_agg', '')), 'string_agg', '')
                   AS payload_digest,
               CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM b""",
    "op7_chat": """
        WITH once AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
        placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i FROM once),
        conv AS MATERIALIZED (SELECT conv_id, list({'r': role, 't': text} ORDER BY i) AS l FROM placed GROUP BY conv_id),
        equal AS (SELECT l, min(conv_id) AS conv_id, count(*) AS copies FROM conv GROUP BY l),
        inner_part AS (SELECT DISTINCT list_slice(l, 1, k) AS l FROM (SELECT l, unnest(range(1, len(l))) AS k FROM equal)),
        kept AS (SELECT e.* FROM equal e ANTI JOIN inner_part p ON p.l = e.l)
        SELECT k.conv_id, ((p.i - 1) // 256)::BIGINT AS part, len(any_value(k.l))::BIGINT AS n_turns, any_value(k.copies) AS copies,
               string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10), '' ORDER BY p.i) AS text,
               sum(CASE WHEN role = 'assistant' THEN length(coalesce(text, '')) ELSE 0 END)::BIGINT AS n_answer_chars
        FROM kept k JOIN placed p ON p.conv_id IS NOT DISTINCT FROM k.conv_id GROUP BY k.conv_id, (p.i - 1) // 256""",
    "op10_line_dedup": r"""
        WITH raw AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS l,
                            generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
        line AS (SELECT doc_id, k, l, list_filter(regexp_split_to_array(l, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM raw),
        long AS (SELECT * FROM line WHERE len(w) >= 8),
        uniq AS MATERIALIZED (SELECT w, min({'d': doc_id, 'k': k}) AS f FROM long GROUP BY w),
        cut AS MATERIALIZED (SELECT w, f, p, list_concat(list_slice(w, 1, p - 1), list_slice(w, p + 1, len(w))) AS rest
                             FROM (SELECT w, f, unnest(range(1, len(w) + 1)) AS p FROM uniq)),
        changed AS (SELECT w FROM (SELECT w, f, min(f) OVER (PARTITION BY p, rest) AS m FROM cut) WHERE m < f),
        shorter AS (SELECT c.w FROM cut c JOIN uniq u ON u.w = c.rest WHERE u.f < c.f),
        longer AS (SELECT u.w FROM cut c JOIN uniq u ON u.w = c.rest WHERE c.f < u.f),
        gone AS (SELECT w FROM changed UNION SELECT w FROM shorter UNION SELECT w FROM longer),
        dropped AS (SELECT g.doc_id, g.k FROM long g JOIN uniq u ON u.w = g.w
                    WHERE {'d': g.doc_id, 'k': g.k} > u.f OR g.w IN (SELECT w FROM gone))
        SELECT r.doc_id, count(*) AS n_lines, count(d.k) AS n_dropped,
               coalesce(string_agg(r.l, chr(10) ORDER BY r.k) FILTER (WHERE d.k IS NULL), '') AS text
        FROM raw r LEFT JOIN dropped d ON d.doc_id = r.doc_id AND d.k = r.k GROUP BY r.doc_id""",
    "op11_jaccard_join": r"""
        WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
        g AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 1, least(len(w), 1) + 1)), lambda i: array_to_string(list_slice(w, i, i + 2), ' ')))) AS l FROM t),
        class AS MATERIALIZED (SELECT l, min(doc_id) AS rep, len(l) AS n FROM g WHERE len(l) > 0 GROUP BY l),
        s AS MATERIALIZED (SELECT rep, n, unnest(l) AS s FROM class),
        link AS MATERIALIZED (SELECT a.rep AS u, b.rep AS v FROM s a JOIN s b ON a.s = b.s AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
                 GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
        way AS MATERIALIZED (SELECT u, v FROM link UNION SELECT v, u FROM link),
        reach AS (SELECT u AS node, u AS root FROM way UNION SELECT way.v, reach.root FROM reach JOIN way ON way.u = reach.node),
        low AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
        SELECT g.doc_id, len(g.l) AS n_shingles, coalesce(low.root, class.rep, g.doc_id) AS component_id
        FROM g LEFT JOIN class ON class.l = g.l LEFT JOIN low ON low.node = class.rep""",
    "op12_centroids": f"""
        WITH e AS (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings WHERE len(embedding) = 64
                   AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        v AS MATERIALIZED (SELECT r, vec_id, unnest(range(64)) AS j, floor(64 * unnest(embedding)::DOUBLE)::BIGINT AS x FROM e),
        first AS (SELECT r, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c FROM e QUALIFY c < 16),
        m0 AS MATERIALIZED (SELECT c, j, x AS m FROM v JOIN first USING (r)),{_rounds_sql(3)},
        h AS (SELECT c, sha256(string_agg(m, ',' ORDER BY j)) AS sha FROM m3 GROUP BY c)
        SELECT e.vec_id, a3.c::INTEGER AS cluster, dist AS distance, (sum(dist) OVER (PARTITION BY a3.c))::BIGINT AS cluster_inertia,
               (sum(dist) OVER ())::BIGINT AS inertia, sha AS centroid_sha256
        FROM a3 JOIN e USING (r) JOIN h ON h.c = a3.c""",
    "op13_resampling": r"""
        WITH RECURSIVE step AS (SELECT range::BIGINT AS b, range::BIGINT AS v, 0 AS i FROM range(256)
            UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, i + 1 FROM step WHERE i < 8),
        crc AS MATERIALIZED (SELECT list(v ORDER BY b) AS t FROM step WHERE i = 8),
        words AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        goal AS MATERIALIZED (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS f FROM benchmark),
        own AS MATERIALIZED (SELECT doc_id, f, count(*) AS n FROM (SELECT doc_id, unnest(w) AS f FROM words) GROUP BY doc_id, f),
        known AS (SELECT DISTINCT f FROM own UNION SELECT f FROM goal),
        hexed AS (SELECT f, hex(encode(f)) AS x FROM known),
        bucket AS MATERIALIZED (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
                     lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1])), 4294967295) % 10000 AS b FROM hexed, crc),
        corpus AS (SELECT b, sum(n) AS s FROM own JOIN bucket USING (f) GROUP BY b),
        target AS (SELECT b, count(*) AS t FROM goal JOIN bucket USING (f) GROUP BY b),
        gain AS MATERIALIZED (SELECT b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM corpus) + 10000)::DOUBLE
                     / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM target) + 10000)::DOUBLE)))::BIGINT AS g FROM corpus LEFT JOIN target USING (b)),
        mean AS (SELECT doc_id, sum(n * g)::BIGINT AS s, sum(n)::BIGINT AS n FROM own JOIN bucket USING (f) JOIN gain USING (b) GROUP BY doc_id),
        scored AS (SELECT doc_id, len(w) AS n_features, coalesce((s - ((s % n) + n) % n) // n, 0) AS weight,
                          ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT AS h FROM words LEFT JOIN mean USING (doc_id)),
        final AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM scored),
        placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM final WHERE n_features >= 20)
        SELECT f.doc_id, n_features, weight, score, CASE WHEN rank <= 10 * (SELECT count(*) FROM placed) // 100 THEN rank END AS rank
        FROM final f LEFT JOIN placed USING (doc_id)""",
}
