"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import canonical_text, name_variants, near_duplicates, packing, shared_spans, similar_vectors, splitting, tokenizer

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_vectors.found_similar(_table(spark, sf_dir, "vectors"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_variants.found_variants(*(_table(spark, sf_dir, t) for t in ("entities", "relations", "lexicon")))


def p2_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_variants.bodies_of(*(_table(spark, sf_dir, t) for t in ("entities", "relations", "lexicon")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.oversized(_table(spark, sf_dir, "parsed_pages"), _table(spark, sf_dir, "chunks"))


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_items(_table(spark, sf_dir, "parsed_pages"), _table(spark, sf_dir, "chunks"))


def p3_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pieces of every item keep: its tokens once each, the limit and the overlap."""
    pieces = p3_pieces(spark, sf_dir)
    later = F.when(F.col("chunk_index") > 0, F.col("repeated"))
    return pieces.groupBy("rec_kind", "rec_id").agg(
        F.sum(F.col("n_tokens") - F.col("repeated")).alias("tokens"), F.max("n_tokens").alias("largest"), F.min(later).alias("least_repeated"), F.max(later).alias("most_repeated"), F.count("*").alias("n"), (F.max("chunk_index") + 1).alias("numbered")
    ).select(
        "rec_kind", "rec_id", "tokens", (F.col("largest") <= splitting.LIMIT).cast("int").alias("within"), (F.coalesce("least_repeated", F.lit(splitting.OVERLAP)) == F.coalesce("most_repeated", F.lit(splitting.OVERLAP))).cast("int").alias("overlap"),
        F.coalesce("most_repeated", F.lit(0)).alias("repeated"), (F.col("n") > 1).cast("int").alias("divided"), (F.col("n") == F.col("numbered")).cast("int").alias("gapless"),
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.found_near_duplicates(_table(spark, sf_dir, "chunks"), _table(spark, sf_dir, "documents"))


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.classes_of(_table(spark, sf_dir, "chunks"), _table(spark, sf_dir, "documents"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_text.found_same_looking(_table(spark, sf_dir, "chunks"), _table(spark, sf_dir, "entities"))


def p6_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical_text.classes_of(_table(spark, sf_dir, "chunks"), _table(spark, sf_dir, "entities"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.encode_documents(_table(spark, sf_dir, "documents"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_spans.shared_spans(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p2_found, p2_bodies, p3_found, p3_pieces, p3_cover, p4_found, p4_classes, p6_found, p6_classes, p7_ids, p8_containers, p9_found)}


WHITE = r"\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
TOKENS = rf"[\x{{3400}}-\x{{9fff}}]|[A-Za-z0-9_]+|[^{WHITE}]"


def _similar(kind: str, rows: str, k: int, least: float) -> str:
    """Pairs of rows (id, text) by their sets of k-character substrings."""
    return f"""SELECT '{kind}' AS rec_kind, least(a.id, b.id) AS id_a, greatest(a.id, b.id) AS id_b FROM {rows}_g a JOIN {rows}_g b ON a.g = b.g AND a.id < b.id
      JOIN {rows}_n x ON x.id = a.id JOIN {rows}_n y ON y.id = b.id GROUP BY a.id, b.id, x.n, y.n HAVING count(*) >= {least} * (x.n + y.n - count(*))"""


def _grams(rows: str, source: str, k: int) -> str:
    return f"""{rows}_g AS (SELECT DISTINCT id, substr(text, i, {k}) AS g FROM (SELECT id, text, unnest(range(1, length(text) - {k - 2})) AS i FROM ({source}) WHERE length(text) >= {k})), {rows}_n AS (SELECT id, count(*) AS n FROM {rows}_g GROUP BY id)"""


def _classes(rows: str, source: str, k: int) -> str:
    """Classes of equal texts, by their smallest id, and the substrings of one member."""
    return f"{rows}_r AS (SELECT id, text FROM ({source}) WHERE length(text) >= {k}), {rows}_c AS (SELECT text, min(id) AS id FROM {rows}_r GROUP BY text), " + _grams(rows, f"SELECT id, text FROM {rows}_c", k)


def _members(kind: str, rows: str) -> str:
    return f"SELECT '{kind}' AS rec_kind, r.id AS rec_id, c.id AS class_id, coalesce(n.links, 0) AS links FROM {rows}_r r JOIN {rows}_c c USING (text) LEFT JOIN n ON n.rec_kind = '{kind}' AND n.id = c.id"


def oracle_sql() -> dict[str, str]:
    """SQL of the queries whose results SQL can give; the others are tested against brute force."""
    chunk = "SELECT DISTINCT chunk_id AS id, content AS text FROM chunks WHERE chunk_id IS NOT NULL"
    titles = "SELECT DISTINCT CAST(doc_id AS VARCHAR) AS id, title AS text FROM documents"
    return {
        "p3_found": f"""WITH items AS (SELECT DISTINCT 'page' AS rec_kind, CAST(page_id AS VARCHAR) AS rec_id, text FROM parsed_pages UNION SELECT DISTINCT 'chunk', chunk_id, content FROM chunks),
          big AS (SELECT * FROM items WHERE text IS NOT NULL AND rec_id IS NOT NULL AND len(regexp_extract_all(text, '{TOKENS}')) > 512)
          SELECT rec_kind, rec_id, CAST(list_max(list_transform(string_split_regex(text, '[。！？!?；;\n]+'), lambda s: len(regexp_extract_all(s, '{TOKENS}')))) > 512 AS INTEGER) AS hard_cut FROM big""",
        "p3_cover": f"""WITH items AS (SELECT DISTINCT 'page' AS rec_kind, CAST(page_id AS VARCHAR) AS rec_id, text FROM parsed_pages UNION SELECT DISTINCT 'chunk', chunk_id, content FROM chunks),
          counted AS (SELECT rec_kind, rec_id, CAST(len(regexp_extract_all(text, '{TOKENS}')) AS BIGINT) AS tokens FROM items WHERE text IS NOT NULL AND rec_id IS NOT NULL)
          SELECT rec_kind, rec_id, tokens, CAST(1 AS INTEGER) AS within, CAST(1 AS INTEGER) AS overlap, CAST(CASE WHEN tokens > 512 THEN 64 ELSE 0 END AS INTEGER) AS repeated, CAST(tokens > 512 AS INTEGER) AS divided, CAST(1 AS INTEGER) AS gapless FROM counted WHERE tokens > 0""",
        "p4_classes": f"WITH {_classes('c', chunk, 5)}, {_classes('t', titles, 2)}, pairs AS ({_similar('chunk', 'c', 5, 0.6)} UNION ALL {_similar('title', 't', 2, 0.75)}), ends AS (SELECT rec_kind, id_a AS id FROM pairs UNION ALL SELECT rec_kind, id_b FROM pairs), n AS (SELECT rec_kind, id, count(*) AS links FROM ends GROUP BY ALL) {_members('chunk', 'c')} UNION ALL {_members('title', 't')}",
        "p4_found": f"WITH {_grams('c', chunk, 5)}, {_grams('t', titles, 2)} {_similar('chunk', 'c', 5, 0.6)} UNION ALL {_similar('title', 't', 2, 0.75)}",
        "p9_found": """WITH w AS (SELECT doc_id, i, md5(substr(text, i, 120)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 118)) AS i FROM documents WHERE length(text) >= 120)),
          two AS (SELECT h FROM w GROUP BY h HAVING count(DISTINCT doc_id) > 1), hit AS (SELECT DISTINCT doc_id, i FROM w WHERE h IN (SELECT h FROM two)),
          covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + 120)) AS at FROM hit) SELECT doc_id, count(*) AS shared_chars FROM covered GROUP BY doc_id""",
    }
