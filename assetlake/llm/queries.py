"""The numbered operators on the driver tables, and the SQL that must agree where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.session import read_table, ship_package
from .common import in_fold
from .decontaminate import decontaminate
from .exact_dedup import drop_copies, normalised
from .html_text import extract_text
from .infill import infill, restored
from .language_id import label_language
from .license_scan import license_summary, scan_licenses
from .lm_scoring import lm_score
from .manifest import audit_assets
from .mixing import mix_batches
from .ngram_join import ngram_join
from .quality import score_quality
from .suffix_dedup import remove_repeats
from .top_k import top_k

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]):
    def shipped(spark: SparkSession, sf: str) -> DataFrame:
        ship_package(spark)
        return run(spark, sf)

    QUERIES[run.__name__] = shipped
    return run


def assets(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as assets."""
    return read_table(spark, sf, "documents").select(
        F.col("doc_id").alias("asset_id"), "text", F.col("source").alias("batch_id"), "lang"
    )


@query
def op2_lm_scoring(spark: SparkSession, sf: str) -> DataFrame:
    """Contexts of two words."""
    return lm_score(assets(spark, sf), order=3).withColumnRenamed("asset_id", "doc_id")


@query
def op3_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return remove_repeats(assets(spark, sf)).select(
        F.col("asset_id").alias("doc_id"),
        "n_bytes",
        "n_removed",
        "n_spans",
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op1_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    """Shingles of four words, similarity 0.85."""
    return ngram_join(assets(spark, sf), size=4, num=85, den=100).withColumnRenamed(
        "asset_id", "doc_id"
    )


@query
def op10_language_id(spark: SparkSession, sf: str) -> DataFrame:
    return label_language(assets(spark, sf)).select(
        F.col("asset_id").alias("doc_id"), "held_out", "lang_pred", "score"
    )


@query
def op4_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    labels = read_table(spark, sf, "labels").select(F.col("doc_id").alias("asset_id"), "quality")
    return score_quality(assets(spark, sf), labels).withColumnRenamed("asset_id", "doc_id")


@query
def op5_license_scans(spark: SparkSession, sf: str) -> DataFrame:
    return license_summary(scan_licenses(assets(spark, sf))).withColumnRenamed("asset_id", "doc_id")


@query
def op6_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return extract_text(read_table(spark, sf, "pages"))


@query
def op9_topk_search(spark: SparkSession, sf: str) -> DataFrame:
    vectors = read_table(spark, sf, "embeddings")
    return top_k(vectors.select(F.col("vec_id").alias("asset_id"), F.col("embedding").alias("vector")))


ORACLE["op9_topk_search"] = """
WITH v AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE) for x in embedding] AS e
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND NOT list_contains([x IS NULL OR NOT isfinite(x) for x in embedding], true)
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 20 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s
)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM r WHERE place <= 20
"""


@query
def op7_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate(assets(spark, sf), read_table(spark, sf, "benchmark")).select(
        F.col("asset_id").alias("doc_id"),
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def _sql_words(text: str) -> str:
    other = r"[^a-z0-9\x{80}-\x{10FFFF}]+"
    lower = (
        f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    )
    return f"[w for w in regexp_split_to_array({lower}, '{other}') if w <> '']"


ORACLE["op7_decontamination"] = f"""
WITH item AS (
  SELECT item_id, w, least(len(w), 10) AS k
  FROM (SELECT item_id, {_sql_words("text")} AS w FROM benchmark) WHERE len(w) > 0
), win AS (
  SELECT DISTINCT item_id, k, array_to_string(w[s + 1:s + k], ' ') AS words
  FROM (SELECT *, unnest(range(len(w) - k + 1)) AS s FROM item)
), doc AS (
  SELECT doc_id, {_sql_words("text")} AS w FROM documents
), size AS (SELECT DISTINCT k FROM win), run AS (
  SELECT doc_id, k, s, array_to_string(w[s + 1:s + k], ' ') AS words
  FROM (SELECT doc_id, w, k, unnest(range(len(w) - k + 1)) AS s FROM doc, size WHERE len(w) >= k)
), hit AS (
  SELECT doc_id, s, k, item_id FROM run JOIN win USING (k, words)
), word AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hit)
  GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(word.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(named.n, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(word.n, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@query
def op8_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mix_batches(assets(spark, sf)).select(
        F.col("asset_id").alias("doc_id"), "size", "source_size", "target", "taken"
    )


ORACLE["op1_ngram_join"] = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, [w for w in regexp_split_to_array(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+') if w <> ''] AS w
  FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[s + 1:s + 4], ' ') AS x
  FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 3, 1))) AS s FROM doc WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
pair AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
  FROM shingle a JOIN shingle b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (
  SELECT a, b FROM pair JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b
  WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
near AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (
  SELECT doc_id, doc_id AS seen FROM documents
  UNION SELECT r.doc_id, n.b FROM reach r JOIN near n ON n.a = r.seen)
SELECT d.doc_id, CAST(coalesce(size.n, 0) AS BIGINT) AS n_shingles, min(seen) AS component_id
FROM documents d LEFT JOIN size USING (doc_id) JOIN reach USING (doc_id) GROUP BY d.doc_id, size.n
"""

ORACLE["op3_suffix_dedup"] = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (
  SELECT doc_id, s, substr(h, CAST(2 * s + 1 AS BIGINT), 100) AS x
  FROM (SELECT doc_id, h, unnest(range(len(h) // 2 - 49)) AS s FROM d WHERE len(h) >= 100)),
f AS (SELECT x, min(doc_id) AS first FROM w GROUP BY x HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, s FROM w JOIN f USING (x) WHERE first < doc_id),
edge AS (
  SELECT doc_id, s, CASE WHEN s - lag(s) OVER o <= 50 THEN 0 ELSE 1 END AS fresh
  FROM hit WINDOW o AS (PARTITION BY doc_id ORDER BY s)),
span AS (
  SELECT doc_id, n, min(s) AS a, max(s) + 50 AS b
  FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS n FROM edge)
  GROUP BY doc_id, n),
gap AS (
  SELECT doc_id, n, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS start FROM span),
cut AS (
  SELECT g.doc_id, count(*) AS spans, sum(b - a) AS gone, max(b) AS last,
    string_agg(substr(h, CAST(2 * start + 1 AS BIGINT), CAST(2 * (a - start) AS BIGINT)), '' ORDER BY a) AS head
  FROM gap g JOIN d USING (doc_id) GROUP BY g.doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, CAST(2 * coalesce(last, 0) + 1 AS BIGINT)))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""


@query
def op11_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return drop_copies(assets(spark, sf)).select(
        F.col("asset_id").alias("doc_id"),
        "keep_id",
        "group_size",
        "kept",
        F.sha2("text", 256).alias("text_sha256"),
    )


_LOWER_TEXT = (
    "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
)

ORACLE["op11_exact_dedup"] = f"""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, sha256(x) AS text_sha256
FROM (SELECT doc_id, {_LOWER_TEXT} AS x FROM documents)
WINDOW w AS (PARTITION BY x)
"""


@query
def op12_fill_in_middle(spark: SparkSession, sf: str) -> DataFrame:
    return infill(assets(spark, sf)).select(
        F.col("asset_id").alias("doc_id"),
        F.col("n_units").alias("n"),
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def _draw(k: int) -> str:
    return f"CAST('0x' || substr(sha256('1:' || doc_id), {8 * k - 7}, 8) AS BIGINT)"


ORACLE["op12_fill_in_middle"] = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
    {_draw(1)} AS h1, {_draw(2)} AS h2, {_draw(3)} AS h3, {_draw(4)} AS h4
  FROM documents
), c AS (
  SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a,
    greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b
  FROM d
), p AS (
  SELECT doc_id, n, x, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid,
    array_to_string(u[b + 1:], '') AS suf,
    CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 90
      THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x
    WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(x) AS restored_sha256
FROM p
"""


@query
def op13_dataset_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Every third asset by the crc32 of its id claims its text in lower case."""
    rows = read_table(spark, sf, "documents").select(
        F.col("doc_id").alias("asset_id"), F.col("source").alias("batch_id"), "lang", "n_chars", "text"
    )
    text = F.col("text")
    lowered = in_fold(F.col("asset_id"), 3, 0) & text.isNotNull()
    return audit_assets(rows, {"text": F.when(lowered, normalised(text)).otherwise(text)}).select(
        F.col("asset_id").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        F.sha2("proof", 256).alias("proof_sha256"),
        "folded_root",
        "verified",
    )


#: Levels that the SQL of the manifest builds per tree: groups of up to 8 to this power.
_SQL_LEVELS = 7


def _sql_tree(name: str, key: str, leaves: str) -> str:
    """CTEs {name}0 to {name}N: (key, k, h) of every level; a sole node stays as it is."""
    steps = [f"{name}0 AS ({leaves})"]
    for level in range(1, _SQL_LEVELS + 1):
        below = f"{name}{level - 1}"
        steps.append(
            f"{name}{level} AS (SELECT {key}, k // 8 AS k, CASE WHEN any_value(n) = 1 THEN min(h) "
            f"ELSE sha256(string_agg(h, '' ORDER BY k)) END AS h FROM "
            f"(SELECT *, count(*) OVER (PARTITION BY {key}) AS n FROM {below}) GROUP BY {key}, k // 8)"
        )
    return ", ".join(steps)


def _sql_climb(name: str, key: str, start: str) -> str:
    """CTEs {name}c0 to {name}cN: the start's rows with `f` folded and `p` appended per level."""
    steps = [f"{name}c0 AS ({start})"]
    for level in range(_SQL_LEVELS):
        beside = (
            f"SELECT {key}, k, h, "
            f"coalesce(string_agg(h, '') OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, "
            f"coalesce(string_agg(h, '') OVER (r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r, "
            f"count(*) OVER (PARTITION BY {key}) AS n FROM {name}{level} "
            f"WINDOW r AS (PARTITION BY {key}, k // 8 ORDER BY k)"
        )
        steps.append(
            f"{name}c{level + 1} AS (SELECT c.* REPLACE (c.{name}k // 8 AS {name}k, "
            f"CASE WHEN b.n = 1 THEN c.f ELSE sha256(b.l || c.f || b.r) END AS f, "
            f"CASE WHEN b.n = 1 THEN c.p ELSE c.p || b.l || b.r END AS p) "
            f"FROM {name}c{level} c JOIN ({beside}) b ON c.{key} = b.{key} AND c.{name}k = b.k)"
        )
    return ", ".join(steps)


def _sql_leaf(text: str) -> str:
    columns = ["doc_id", "source", "lang", "n_chars", text]
    parts = [f"CAST({c} AS VARCHAR)" for c in columns]
    return "sha256(" + " || ".join(
        f"coalesce(octet_length(encode({p})) || ':' || {p}, '-')" for p in parts
    ) + ")"


#: crc32 of the id as text, bit by bit.
_SQL_CRC = """xor(4294967295, list_reduce(
    list_concat([4294967295], [CAST(ord(c) AS BIGINT) for c in string_split(CAST(doc_id AS VARCHAR), '')]),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
      lambda x, bit: xor(x >> 1, 3988292384 * (x & 1)))))"""
_CLAIM = f"CASE WHEN {_SQL_CRC} % 3 = 0 THEN {_LOWER_TEXT} ELSE text END"

ORACLE["op13_dataset_manifest"] = f"""
WITH d AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g, {_sql_leaf("text")} AS leaf,
    CASE WHEN text IS NULL THEN {_sql_leaf("text")} ELSE {_sql_leaf(f"({_CLAIM})")} END AS claimed
  FROM documents
), o AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, claimed) - 1 AS place FROM d
), {_sql_tree("t", "g", "SELECT g, place AS k, leaf AS h FROM o")},
u AS (SELECT 1 AS one, row_number() OVER (ORDER BY g) - 1 AS k, g, h FROM t{_SQL_LEVELS}),
{_sql_tree("s", "one", "SELECT one, k, h FROM u")},
{_sql_climb("t", "g", "SELECT doc_id, g, place AS tk, leaf, claimed AS f, '' AS p FROM o")},
up AS (SELECT c.*, u.h AS subroot, u.one, u.k AS sk FROM tc{_SQL_LEVELS} c JOIN u USING (g)),
{_sql_climb("s", "one", "SELECT * FROM up")}
SELECT doc_id, leaf, subroot, h AS root, sha256(p) AS proof_sha256, f AS folded_root, f = h AS verified
FROM sc{_SQL_LEVELS} JOIN s{_SQL_LEVELS} USING (one)
"""
