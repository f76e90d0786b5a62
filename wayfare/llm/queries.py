"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fill_middle, merkle, pii, toxicity, warc
from .common import table
from .decontaminate import contaminated
from .exact_dedup import exact_groups
from .html_text import main_text
from .minhash import near_duplicates
from .quality import quality
from .token_count import count_tokens
from .url_filter import judge_urls

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKEN_LIMIT = 4096
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block")]


TOXIC_AT = 0.3


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of a contaminated document and an item that it contains."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select("doc_id", "text"), model).select(
        "doc_id", toxicity.held_out("doc_id").alias("held_out"), "score",
        (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the archives, then reads every record back."""
    return warc.read(warc.write(table(spark, sf_dir, "pages"))).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def tokens(docs: DataFrame) -> DataFrame:
    """Digests of the ids of each text and of the bytes they decode to."""
    done = bpe.encode(docs.select("doc_id", "text"), bytes_col="decoded")
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return done.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
                       F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return found.select("doc_id", *map(count, pii.BASE), F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents, and what they say of tampered ones."""
    docs = table(spark, sf_dir, "documents")
    row = lambda text: merkle.leaf_hash([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text])
    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    found = F.when(hit, row(F.translate("text", UPPER, LOWER)))
    proofs = merkle.manifest(docs, row(F.col("text")), carry={"found": found})
    folded = merkle.fold(F.coalesce("found", "leaf"), F.col("path"))
    return proofs.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"),
                         folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    restored = fill_middle.restore(F.col("output"), F.col("form"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(restored, 256).alias("restored_sha256"))


def op13_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


OP4_SQL = """
WITH rules(rhost, rpath, rverdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
    ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
rest AS (SELECT page_id, CASE WHEN position('://' IN url) > 0
             THEN substr(url, position('://' IN url) + 3) ELSE '' END AS r FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                    'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
urls AS (SELECT DISTINCT host, path FROM parts),
fits AS (SELECT host, path, rhost || rpath AS rule, rverdict,
                row_number() OVER (PARTITION BY host, path ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS k
         FROM urls JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, parts.host, parts.path, rule, coalesce(rverdict, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM fits WHERE k = 1) f ON parts.host = f.host AND parts.path = f.path
"""

OP7_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
FROM g
"""

OP10_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents)
"""


OP11_SQL = """
WITH RECURSIVE rows AS (
    SELECT doc_id, lang, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
               || coalesce(strlen(lang) || ':' || lang, '-')
               || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head, text,
           list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(doc_id::VARCHAR, ''),
                           lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
                       lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) ELSE xor(x >> 1, 3988292384 * (x & 1)) END) AS c
    FROM documents),
made AS (SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                                         'abcdefghijklmnopqrstuvwxyz'), '-')) AS low,
                coalesce(xor(c, 4294967295) % 3 = 0, false) AS hit FROM rows),
leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
                  count(*) OVER (PARTITION BY lang) AS n FROM made),
-- the trees of the languages, level by level
tree(lvl, lang, pos, n, h) AS (
    SELECT 0, lang, pos, n, leaf FROM leaves
    UNION ALL
    SELECT lvl + 1, lang, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM tree WHERE n > 1
    GROUP BY lvl, lang, pos // 8, n),
subroots AS (SELECT lang, h AS subroot, lvl AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos,
                    count(*) OVER () AS n FROM tree WHERE n = 1),
top(lvl, pos, n, h) AS (
    SELECT 0, pos, n, subroot FROM subroots
    UNION ALL
    SELECT lvl + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1
    GROUP BY lvl, pos // 8, n),
sides AS (
    SELECT false AS up, lvl, lang, pos, coalesce(string_agg(h, '') OVER (a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
           coalesce(string_agg(h, '') OVER (a ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
    FROM tree WHERE n > 1 WINDOW a AS (PARTITION BY lvl, lang, pos // 8 ORDER BY pos)
    UNION ALL
    SELECT true, lvl, NULL, pos, coalesce(string_agg(h, '') OVER (a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''),
           coalesce(string_agg(h, '') OVER (a ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '')
    FROM top WHERE n > 1 WINDOW a AS (PARTITION BY lvl, pos // 8 ORDER BY pos)),
-- the way of a leaf up to the root
way AS (
    SELECT l.lang, l.pos, s.subroot, s.height + k.lvl AS step, t.l, t.r
    FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang
    JOIN (SELECT DISTINCT lvl FROM sides WHERE up) k ON true
    JOIN sides t ON t.up AND t.lvl = k.lvl AND t.pos = s.pos // (8 ** k.lvl)::BIGINT
    UNION ALL
    SELECT l.lang, l.pos, s.subroot, k.lvl, t.l, t.r
    FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang
    JOIN (SELECT DISTINCT lvl FROM sides WHERE NOT up) k ON k.lvl < s.height
    JOIN sides t ON NOT t.up AND t.lvl = k.lvl AND t.lang IS NOT DISTINCT FROM l.lang AND t.pos = l.pos // (8 ** k.lvl)::BIGINT),
paths AS (SELECT lang, pos, list(l ORDER BY step) AS ls, list(r ORDER BY step) AS rs, string_agg(l || r, '' ORDER BY step) AS joined
          FROM way GROUP BY lang, pos),
folds(lang, pos, step, h) AS (
    SELECT lang, pos, 0, CASE WHEN hit THEN low ELSE leaf END FROM leaves
    UNION ALL
    SELECT f.lang, f.pos, step + 1, sha256(ls[step + 1] || h || rs[step + 1])
    FROM folds f JOIN paths p ON f.lang IS NOT DISTINCT FROM p.lang AND f.pos = p.pos WHERE step < len(ls)),
folded AS (SELECT lang, pos, arg_max(h, step) AS folded_root FROM folds GROUP BY lang, pos)
SELECT l.doc_id, l.leaf, s.subroot, t.h AS root, sha256(coalesce(p.joined, '')) AS proof_sha256, f.folded_root,
       f.folded_root = t.h AS verified
FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang
JOIN (SELECT h FROM top WHERE n = 1) t ON true
JOIN folded f ON l.lang IS NOT DISTINCT FROM f.lang AND l.pos = f.pos
LEFT JOIN paths p ON l.lang IS NOT DISTINCT FROM p.lang AND l.pos = p.pos
"""

OP12_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS g,
                  regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
h AS (SELECT *, len(u) AS n, ('0x' || substr(g, 1, 8))::UBIGINT % (len(u) + 1) AS a, ('0x' || substr(g, 9, 8))::UBIGINT % (len(u) + 1) AS b,
             text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                 OR ('0x' || substr(g, 17, 8))::UBIGINT % 100 >= 50 AS plain,
             ('0x' || substr(g, 25, 8))::UBIGINT % 100 < 80 AS spm FROM d),
c AS (SELECT doc_id, n, text, plain, spm, array_to_string(u[1:least(a, b)], '') AS p,
             array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:], '') AS s FROM h)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
       CASE WHEN NOT plain THEN length(p) END AS prefix_chars, CASE WHEN NOT plain THEN length(m) END AS middle_chars,
       sha256(CASE WHEN plain THEN text WHEN spm THEN '<S>' || s || '<P>' || p || '<M>' || m
                   ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM c
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_html_text, op3_decontamination, op4_url_filter, op5_minhash, op6_toxicity,
                                   op7_warc, op8_bpe, op9_pii, op10_exact_dedup, op11_merkle, op12_fill_middle,
                                   op13_token_count)}


def oracle_sql() -> dict[str, str]:
    return {"op4_url_filter": OP4_SQL, "op7_warc": OP7_SQL, "op10_exact_dedup": OP10_SQL,
            "op11_merkle": OP11_SQL, "op12_fill_middle": OP12_SQL}
