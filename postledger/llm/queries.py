"""Registered queries of the thirteen operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postledger.llm import language, packing, pieces, quality, secret_scan, token_count
from postledger.llm.exact_topk import exact_topk
from postledger.llm.graph_ann import nearest
from postledger.llm.jaccard_join import jaccard_components
from postledger.llm.line_dedup import dedup_lines
from postledger.llm.prefix_trie import prefix_trie, rebuilt_paths
from postledger.llm.spelling import spelling_groups
from postledger.llm.substrings import drop_repeats


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(secret_scan.joined("base"), 256).alias("base_sha256"),
        secret_scan.joined("found").alias("spans"),
        secret_scan.joined_links("links").alias("links"),
    )


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op4_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op5_graph_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", F.col("n_removed_lines").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    worth = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return quality.score(docs, worth).select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted")
    )


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(_table(spark, sf_dir, "embeddings"))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(_table(spark, sf_dir, "documents")).drop("kept")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt_paths(_table(spark, sf_dir, "conversations")))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = language.predict(docs, language.fit(docs))
    return found.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op13_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_token_count": op4_token_count,
    "op5_graph_ann": op5_graph_ann,
    "op6_line_dedup": op6_line_dedup,
    "op7_quality": op7_quality,
    "op8_exact_topk": op8_exact_topk,
    "op9_pieces": op9_pieces,
    "op10_substrings": op10_substrings,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_language_id": op12_language_id,
    "op13_spelling_groups": op13_spelling_groups,
}


def _secret_sql() -> str:
    """The same parts and range frames over DuckDB's lists."""
    names, parts = list(secret_scan.PATTERNS), []
    for k, (name, (pattern, group, least)) in enumerate(secret_scan.PATTERNS.items()):
        p = pattern.replace("'", "''")
        mixed = " AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[0-9]')" if name == "key" else ""
        parts.append(
            f"SELECT rid, {k} AS kind, a, a + n AS b FROM (SELECT rid, length(w[i]) AS n, x[i] AS v, "
            "list_sum(list_transform(g[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(w[1:i-1], lambda y: length(y))), 0) AS a "
            f"FROM (SELECT rid, w, g, x, unnest(range(1, len(w) + 1)) AS i FROM (SELECT rid, regexp_extract_all(t, '{p}') AS w, "
            f"string_split_regex(t, '{p}') AS g, regexp_extract_all(t, '{p}', {group}) AS x FROM d))) WHERE length(v) >= {least}{mixed}"
        )
    near = f"OVER (PARTITION BY rid, scope ORDER BY a RANGE BETWEEN {secret_scan.REACH} PRECEDING AND {secret_scan.REACH} FOLLOWING) > 0"
    case = lambda k, a, b: f"CASE {k} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names)) + f" END || ':' || {a} || ':' || {b}"
    seek = lambda kinds, f, rows: f"{f}(CASE WHEN kind IN ({kinds}) THEN {{'a': a, 'kind': kind, 'b': b}} END IGNORE NULLS) OVER (PARTITION BY rid, scope ORDER BY a, kind ROWS BETWEEN {rows})"
    back, ahead = "UNBOUNDED PRECEDING AND 1 PRECEDING", "1 FOLLOWING AND UNBOUNDED FOLLOWING"
    pick = lambda x, y: (
        f"CASE WHEN least(coalesce(a - {x}.a, 1000000), coalesce({y}.a - a, 1000000)) <= {secret_scan.REACH} THEN CASE WHEN {y} IS NULL OR ({x} IS NOT NULL AND a - {x}.a <= {y}.a - a) THEN {x} ELSE {y} END END"
    )
    link = case("kind", "a", "b") + " || '<' || " + case("who_at.kind", "who_at.a", "who_at.b") + " || CASE WHEN end_at IS NULL THEN '' ELSE '@' || " + case("end_at.kind", "end_at.a", "end_at.b") + " END"
    one = case("kind", "a", "b")
    return (
        "WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), p AS (" + " UNION ALL ".join(parts) + "), "
        "s AS (SELECT *, sum(CASE WHEN kind = 6 THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY a RANGE UNBOUNDED PRECEDING) AS scope, "
        "max(CASE WHEN kind IN (0, 1, 2, 4, 5) THEN b END) OVER (PARTITION BY rid ORDER BY a RANGE UNBOUNDED PRECEDING) AS other FROM p), "
        "k AS (SELECT * FROM s WHERE kind <> 3 OR other IS NULL OR other <= a), "
        f"f AS (SELECT *, sum(CASE WHEN kind IN (1, 4) THEN 1 ELSE 0 END) {near} AS who, sum(CASE WHEN kind IN (0, 2, 3) THEN 1 ELSE 0 END) {near} AS what, "
        f"{seek('1, 4', 'last_value', back)} AS w1, {seek('1, 4', 'first_value', ahead)} AS w2, {seek('5', 'last_value', back)} AS e1, {seek('5', 'first_value', ahead)} AS e2 FROM k), "
        f"r AS (SELECT rid, kind, a, b, kind < 3 OR (kind = 3 AND who) OR (kind = 4 AND what) OR (kind = 5 AND who AND what) AS told, "
        f"CASE WHEN kind IN (0, 2, 3) THEN {pick('w1', 'w2')} END AS who_at, CASE WHEN kind IN (0, 2, 3) THEN {pick('e1', 'e2')} END AS end_at FROM f) "
        "SELECT any_value(d.doc_id) AS doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex, "
        f"sha256(coalesce(string_agg({one}, ',' ORDER BY a, kind) FILTER (WHERE kind < 3), '')) AS base_sha256, "
        f"coalesce(string_agg({one}, ',' ORDER BY a, kind) FILTER (WHERE told), '') AS spans, "
        f"coalesce(string_agg({link}, ',' ORDER BY a, kind) FILTER (WHERE who_at IS NOT NULL), '') AS links FROM d LEFT JOIN r ON d.rid = r.rid GROUP BY d.rid"
    )


#: Table of the reflected CRC-32 polynomial, and the checksum of a list of bytes by it.
_CRC_TABLE = """crc AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(range(8),
    lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) AS v FROM range(256) r(i)))"""


def _crc(octets: str) -> str:
    return f"xor(list_reduce({octets}, lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1]), 4294967295), 4294967295)"


_TRIE_SQL = f"""WITH {_CRC_TABLE},
    turns AS (SELECT conv_id AS c, turn, strlen(coalesce(text, '')) AS size,
        substr(sha256(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))), 1, 32) AS mark FROM conversations WHERE conv_id IS NOT NULL),
    own AS (SELECT c, list({{'m': mark, 's': size}} ORDER BY turn NULLS FIRST, mark, size) AS own FROM turns GROUP BY c),
    share AS (SELECT c, own, c - c % 5 AS b, {_crc("list_transform(string_split(CAST(c AS VARCHAR), ''), lambda y: CAST(ord(y) AS BIGINT))")} % 9 AS h FROM own, crc),
    whole AS (SELECT s.c, list_concat(coalesce(l.own, [])[1:h], s.own[h+1:]) AS p FROM share s LEFT JOIN own l ON l.c = s.b),
    steps AS (SELECT c, len(p) AS size, p, unnest(range(0, len(p) + 1)) AS d FROM whole),
    nodes AS (SELECT p[1:d] AS p, d, min(c) AS conv_id, count(*) AS n, any_value(CASE WHEN d > 0 THEN p[d].s ELSE 0 END) AS size,
        coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (size = d), '') AS ids FROM steps GROUP BY 1, 2),
    kids AS (SELECT p[1:d-1] AS p, count(*) AS k FROM nodes WHERE d > 0 GROUP BY 1),
    told AS (SELECT n.*, coalesce(k, 0) AS k FROM nodes n LEFT JOIN kids ON kids.p = n.p),
    sums AS (SELECT p[1:e] AS p, sum(CASE WHEN k = 0 THEN 1 ELSE 0 END) AS leaves, sum((n - 1) * size) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM told) GROUP BY 1)
    SELECT t.conv_id, CAST(t.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, t.n AS n_convs, t.k AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
        CAST(saved AS BIGINT) AS saved_tokens, sha256(t.ids) AS ends_sha256
    FROM told t JOIN sums ON sums.p = t.p LEFT JOIN nodes u ON u.d = t.d - 1 AND u.p = t.p[1:t.d-1]"""

_SPELLING_SQL = f"""WITH RECURSIVE {_CRC_TABLE},
    runs AS (SELECT CAST(doc_id AS VARCHAR) AS id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
    said AS (SELECT id, w, count(*) AS n FROM runs WHERE length(w) >= 6 GROUP BY 1, 2),
    marked AS (SELECT w, n, {_crc("flatten(list_transform(string_split(id || ':' || w, ''), lambda y: CASE WHEN ord(y) < 128 THEN [CAST(ord(y) AS BIGINT)] ELSE [195, CAST(ord(y) AS BIGINT) - 64] END))")} AS h FROM said, crc),
    spoilt AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM marked),
    words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spoilt WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
    cuts AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS d FROM (SELECT word, unnest(range(0, length(word))) AS i FROM words)),
    pairs AS (SELECT x.word AS a, y.word AS b FROM cuts x JOIN cuts y ON x.i = y.i AND x.d = y.d AND x.word <> y.word
        UNION SELECT c.word, w.word FROM cuts c JOIN words w ON c.d = w.word UNION SELECT w.word, c.word FROM cuts c JOIN words w ON c.d = w.word),
    best AS (SELECT a, count(*) OVER (PARTITION BY a) AS k, b, n, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS r FROM pairs JOIN words ON b = word),
    formed AS (SELECT w.word, w.n, coalesce(k, 0) AS n_near, CASE WHEN best.n >= 5 * w.n THEN b END AS form, CASE WHEN best.n >= 5 * w.n THEN best.n END AS form_n
        FROM words w LEFT JOIN best ON a = w.word AND r = 1),
    walk AS (SELECT word, word AS at, form AS onto FROM formed UNION ALL SELECT walk.word, f.word, f.form FROM walk JOIN formed f ON walk.onto = f.word)
    SELECT f.word, f.form, walk.at AS root, f.n, f.n_near, f.form_n FROM formed f JOIN walk ON walk.word = f.word AND walk.onto IS NULL"""

SQL: dict[str, str] = {
    "op11_prefix_trie": _TRIE_SQL,
    "op13_spelling_groups": _SPELLING_SQL,
    "op1_secret_scan": _secret_sql(),
    "op8_exact_topk": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS z FROM embeddings WHERE embedding IS NOT NULL),
        s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.z, v.z) AS BIGINT) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0)
        SELECT query_id, rank, vec_id, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s) WHERE rank <= 10""",
}
