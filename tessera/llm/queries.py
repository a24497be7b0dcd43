"""The registered query of each operator, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.shared import Scratch, plain, table

TOKENIZER = "byte_bpe_50k.json"
PIECE_MODEL = "piece_bpe_32k.model"

URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tessera.llm.quality import QualityClassifier, held_out

    docs = plain(table(spark, sf_dir, "documents"), "doc_id", "text", "n_chars")
    labels = plain(table(spark, sf_dir, "labels"), "doc_id", "quality")
    fitted = QualityClassifier(metadata=("n_chars",)).fit(docs, labels, "quality", ~held_out(F.col("doc_id")))
    return fitted.score(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm.piece_dropout import round_trip

    return round_trip(plain(table(spark, sf_dir, "documents"), "doc_id", "text"), public_tokenizers.path(PIECE_MODEL))


#: Wanted shares of tokens by domain.
MIX = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2, "toxic": 0.0}


def mix_labels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, domain of the labelled table: toxic, or else the document's language."""
    from pyspark.sql import functions as F

    marks = labels.filter("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return docs.select("doc_id", "lang").join(marks, "doc_id").select("doc_id", F.when(F.col("toxic") == 1, "toxic").otherwise(F.col("lang")).alias("domain"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm.mixing import mixing_rates

    docs, labels = plain(table(spark, sf_dir, "documents"), "doc_id", "text", "lang"), plain(table(spark, sf_dir, "labels"), "doc_id", "toxic")
    return mixing_rates(docs, mix_labels(docs, labels), MIX, tokenizer=public_tokenizers.path(TOKENIZER))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.fingerprint import compare_edited

    return compare_edited(plain(table(spark, sf_dir, "documents"), "doc_id", "text"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.topk import top_k

    return top_k(plain(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.url_filter import judge_urls

    return judge_urls(plain(table(spark, sf_dir, "pages"), "page_id", "url", "html"), URL_RULES)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.substring_dedup import dedup_substrings

    return dedup_substrings(plain(table(spark, sf_dir, "documents"), "doc_id", "text"), digest_only=True)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm.token_counts import token_counts

    return token_counts(plain(table(spark, sf_dir, "documents"), "doc_id", "text"), public_tokenizers.path(TOKENIZER))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.jaccard import jaccard_components

    return jaccard_components(plain(table(spark, sf_dir, "documents"), "doc_id", "text"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.warc import assemble, page_facts, read_warc, write_warc

    scratch = Scratch(spark, "warc")
    write_warc(plain(table(spark, sf_dir, "pages"), "page_id", "url", "html"), f"{scratch.path}/archive")
    return page_facts(assemble(read_warc(spark, f"{scratch.path}/archive", payload=False)))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm.token_alignment import align_tokens

    return align_tokens(plain(table(spark, sf_dir, "documents"), "doc_id", "text"), public_tokenizers.path(TOKENIZER), public_tokenizers.path(PIECE_MODEL))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.suffix_dedup import dedup_bytes

    return dedup_bytes(plain(table(spark, sf_dir, "documents"), "doc_id", "text"), digest_only=True)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from tessera.llm.merkle import leaf_hash, manifest, verified

    docs = plain(table(spark, sf_dir, "documents"), "doc_id", "source", "lang", "n_chars", "text")
    even = F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0)
    cut = F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))
    fields = ("doc_id", "source", "lang", "n_chars")
    leaves = docs.select("source", "doc_id", leaf_hash(*fields, "text").alias("leaf"), F.when(even & F.col("text").contains("\n"), leaf_hash(*fields, cut)).alias("tampered"))
    out = verified(manifest(leaves), F.coalesce("tampered", "leaf"))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_merge_dropout": op2_merge_dropout,
    "op3_fingerprints": op3_fingerprints,
    "op4_topk": op4_topk,
    "op5_urls": op5_urls,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_token_counts": op7_token_counts,
    "op8_jaccard": op8_jaccard,
    "op9_warc": op9_warc,
    "op10_mixing": op10_mixing,
    "op11_token_alignment": op11_token_alignment,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_merkle": op13_merkle,
}


def _op4_sql() -> str:
    return """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
  WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def _op5_sql() -> str:
    from tessera.llm.url_filter import DAMPING, ROUNDS, UNITS, rules_sql

    host = lambda u: f"translate(coalesce(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    sql = f"""
WITH rules(h, p, a) AS (VALUES {rules_sql(URL_RULES)}),
parts AS (
  SELECT page_id, html, {host('url')} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), named AS (SELECT *, row_number() OVER () AS row_no FROM parts),
judged AS (
  SELECT n.row_no, n.page_id, n.host, n.path,
         first(r.h || r.p ORDER BY length(r.h || r.p) DESC, r.a DESC) FILTER (r.h IS NOT NULL) AS rule,
         first(r.a ORDER BY length(r.h || r.p) DESC, r.a DESC) FILTER (r.h IS NOT NULL) AS action
  FROM named n LEFT JOIN rules r ON (n.host = r.h OR ends_with(n.host, '.' || r.h)) AND starts_with(n.path, r.p)
  GROUP BY ALL
), links AS (
  SELECT host AS src, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*?href\\s*=\\s*["'']?((?:https?:)?//[^"''\\s>]+)', 1)) AS link FROM parts
), targets AS (
  SELECT src, {host("CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END")} AS dst FROM links
), edges AS (
  SELECT src, dst, count(*) AS w FROM targets WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY ALL
), back AS (SELECT dst AS src, src AS dst, w FROM edges)"""
    for name, action, graph in (("trust", "allow", "edges"), ("distrust", "block", "back")):
        sql += f""",
{name}_n AS (SELECT host, count(*) AS n FROM judged WHERE action = '{action}' GROUP BY host),
{name}_home AS (SELECT host, CAST(n AS HUGEINT) * {UNITS} // (SELECT sum(n) FROM {name}_n) AS home FROM {name}_n),
{name}_share AS (SELECT src, dst, w, sum(w) OVER (PARTITION BY src) AS o FROM {graph}),
{name}_0 AS MATERIALIZED (SELECT host, home AS rank FROM {name}_home)"""
        for i in range(ROUNDS):
            sql += f""",
{name}_{i + 1} AS MATERIALIZED (
  SELECT host, CASE WHEN (SELECT count(*) FROM {name}_share) = 0 THEN max(home) ELSE sum(got) + sum(home) * {100 - DAMPING} // 100 END AS rank FROM (
    SELECT s.dst AS host, (CAST(r.rank AS HUGEINT) * {DAMPING} // 100) * s.w // s.o AS got, CAST(0 AS HUGEINT) AS home FROM {name}_share s JOIN {name}_{i} r ON s.src = r.host
    UNION ALL SELECT host, CAST(0 AS HUGEINT), home FROM {name}_home) GROUP BY host)"""
    return sql + f""",
blocked AS (
  SELECT d.host FROM distrust_{ROUNDS} d LEFT JOIN trust_{ROUNDS} t ON d.host = t.host WHERE d.host <> '' AND d.rank > coalesce(t.rank, 0)
)
SELECT j.page_id, j.host, j.path, j.rule, coalesce(j.action, CASE WHEN b.host IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM judged j LEFT JOIN blocked b ON j.host = b.host
"""


_WORDS = r"[^\x20\x09-\x0D]+"


def _op6_sql() -> str:
    from tessera.llm.substring_dedup import SPAN

    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS ws FROM documents),
starts AS (SELECT doc_id, unnest(range(1, len(ws) - {SPAN - 2})) AS i, ws FROM w WHERE len(ws) >= {SPAN} AND doc_id IS NOT NULL),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + {SPAN - 1}], ' ') AS g FROM starts),
bad AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS least FROM windows),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {SPAN})) AS p FROM bad WHERE least < doc_id),
lost AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN ps IS NULL THEN ws ELSE list_filter(ws, lambda x, j: NOT list_contains(ps, j)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN lost ON w.doc_id = lost.doc_id
"""


def _op8_sql() -> str:
    return f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS ws FROM documents
), g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w
), n AS (SELECT w.doc_id, count(g.s) AS n FROM w LEFT JOIN g ON w.doc_id = g.doc_id GROUP BY w.doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach(doc_id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT l.b, r.c FROM reach r JOIN links l ON r.doc_id = l.a WHERE r.c < l.b)
SELECT n.doc_id, CAST(n AS BIGINT) AS n_shingles, min(c) AS component_id FROM n JOIN reach ON n.doc_id = reach.doc_id GROUP BY ALL
"""


def _op9_sql() -> str:
    # base32 of the SHA-1: the digest is cut into eight groups of 20 bits, four letters each
    letter = lambda shift: f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((g >> {shift}) & 31) + 1, 1)"
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex FROM p),
e AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(list_transform(range(8), lambda i: CAST('0x' || substr(hex, CAST(5 * i + 1 AS BIGINT), 5) AS BIGINT)),
         lambda g: {letter(15)} || {letter(10)} || {letter(5)} || {letter(0)}), '') AS payload_digest FROM d
), r AS (SELECT *, row_number() OVER w AS n, first_value(page_id) OVER w AS best FROM e WINDOW w AS (PARTITION BY payload_digest ORDER BY page_id DESC NULLS LAST))
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN n = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN n = 1 THEN NULL ELSE best END AS refers_to
FROM r
"""


def _op13_sql() -> str:
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    # crc32 byte by byte: eight shifts each, and the polynomial where a one falls out
    bits = "list_reduce(list_prepend(x, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda r, b: list_transform([xor(r, b)], lambda x: {bits})[1]), 4294967295)"
    return f"""
WITH RECURSIVE l AS (
  SELECT row_number() OVER () AS row_no, doc_id, source, {leaf('text')} AS leaf, CASE WHEN doc_id IS NOT NULL AND {crc} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} END AS tampered FROM documents
), n AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, row_no) - 1 AS i, count(*) OVER (PARTITION BY source) AS c FROM l
), tree(tree, lvl, i, c, h) AS (
  SELECT source, 0, i, c, leaf FROM n
  UNION ALL
  SELECT tree, lvl + 1, i // 3, (c + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM tree WHERE c > 1 GROUP BY tree, lvl, i // 3, c
), sub AS (
  SELECT tree, h, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS i, count(*) OVER () AS c FROM tree WHERE c = 1
), top(lvl, i, c, h) AS (
  SELECT 0, i, c, h FROM sub
  UNION ALL
  SELECT lvl + 1, i // 3, (c + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE c > 1 GROUP BY lvl, i // 3, c
), path(row_no, tree, lvl, i, c) AS (
  SELECT row_no, source, 0, i, c FROM n UNION ALL SELECT row_no, tree, lvl + 1, i // 3, (c + 2) // 3 FROM path WHERE c > 1
), up(row_no, lvl, i, c) AS (
  SELECT n.row_no, 0, s.i, s.c FROM n JOIN sub s ON n.source IS NOT DISTINCT FROM s.tree UNION ALL SELECT row_no, lvl + 1, i // 3, (c + 2) // 3 FROM up WHERE c > 1
), steps AS (
  SELECT p.row_no, p.lvl AS k, list(t.h ORDER BY t.i) FILTER (t.i < p.i) AS before, list(t.h ORDER BY t.i) FILTER (t.i > p.i) AS after
  FROM path p JOIN tree t ON p.tree IS NOT DISTINCT FROM t.tree AND p.lvl = t.lvl AND p.i // 3 = t.i // 3 WHERE p.c > 1 GROUP BY ALL
  UNION ALL
  SELECT p.row_no, 1000 + p.lvl, list(t.h ORDER BY t.i) FILTER (t.i < p.i), list(t.h ORDER BY t.i) FILTER (t.i > p.i)
  FROM up p JOIN top t ON p.lvl = t.lvl AND p.i // 3 = t.i // 3 WHERE p.c > 1 GROUP BY ALL
), numbered AS (
  SELECT row_no, row_number() OVER (PARTITION BY row_no ORDER BY k) AS k, coalesce(array_to_string(before, ''), '') AS before, coalesce(array_to_string(after, ''), '') AS after FROM steps
), proof AS (SELECT row_no, sha256(string_agg(before || after, '' ORDER BY k)) AS proof_sha256, max(k) AS depth FROM numbered GROUP BY row_no),
folded(row_no, k, h) AS (
  SELECT row_no, 0, coalesce(tampered, leaf) FROM n
  UNION ALL
  SELECT f.row_no, f.k + 1, sha256(s.before || f.h || s.after) FROM folded f JOIN numbered s ON f.row_no = s.row_no AND s.k = f.k + 1
)
SELECT n.doc_id, n.leaf, s.h AS subroot, r.h AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM n JOIN sub s ON n.source IS NOT DISTINCT FROM s.tree CROSS JOIN (SELECT h FROM top WHERE c = 1) r
LEFT JOIN proof p ON n.row_no = p.row_no JOIN folded f ON n.row_no = f.row_no AND f.k = coalesce(p.depth, 0)
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_substring_dedup": _op6_sql(), "op8_jaccard": _op8_sql(), "op4_topk": _op4_sql(), "op5_urls": _op5_sql(), "op9_warc": _op9_sql(), "op13_merkle": _op13_sql()}
