"""The queries of the dealt problems, each over its whole tables, and the SQL of those that SQL can say."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scanloom.sources.tables import table


def _kind(name: str = "vultype"):
    """A kind of finding as the problems compare it: without spaces at both ends, in lower case, null if empty."""
    kind = F.lower(F.trim(F.col(name)))
    return F.when(kind != "", kind)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings among the first 5 of their task and kind by complexity."""
    from scanloom.llm.topn import top_n_per_group

    rows = table(spark, sf_dir, "vulfile").select("id", "taskid", _kind().alias("kind"), "max_ccn", "avgccn")
    return top_n_per_group(rows, ["taskid", "kind"], [("max_ccn", True), ("avgccn", True)], "id", 5).select("id").distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of findings of one kind whose source_code is nearly the same."""
    from scanloom.llm.neardup import near_duplicate_pairs

    pairs = near_duplicate_pairs(table(spark, sf_dir, "vulfile"), "id", "source_code", _kind(), threshold=0.6, width=3, min_tokens=30)
    return pairs.select("id_a", "id_b")


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each finding with the least id of the exact copies of its source_code and the number of others that it is nearly the same as."""
    from scanloom.llm.neardup import near_duplicate_classes

    return near_duplicate_classes(table(spark, sf_dir, "vulfile"), "id", "source_code", _kind(), threshold=0.6, width=3, min_tokens=30)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that nobody wrote by hand here; a repository is the project of the file's task."""
    from scanloom.llm.handwritten import listed, not_handwritten

    libraries = listed(table(spark, sf_dir, "known_library").select("lib_name"))
    repos = table(spark, sf_dir, "vuldetail").select("taskid", "itemid")
    return not_handwritten(table(spark, sf_dir, "vulfile"), "fileid", "filename", "filepath", "source_code", "taskid", libraries, repos)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every credential's place in source_code."""
    from scanloom.llm.credentials import find_credentials

    return find_credentials(table(spark, sf_dir, "vulfile"), "id", "source_code", "filename")


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each finding's source_code with its credentials blanked and all else in place."""
    from scanloom.llm.credentials import redacted

    rows = table(spark, sf_dir, "vulfile").select("id", "source_code", "filename")
    return rows.select("id", redacted(F.col("source_code"), F.col("filename")).alias("source_code"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every source_code longer than 2000 characters."""
    from scanloom.llm.pieces import split_oversized

    return split_oversized(table(spark, sf_dir, "vulfile"), "id", "source_code")


def p5_bisect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same texts cut by recursive bisection."""
    from scanloom.llm.pieces import split_oversized

    return split_oversized(table(spark, sf_dir, "vulfile"), "id", "source_code", method="bisect")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's text as ids of byte_bpe_50k."""
    from scanloom.llm.encode import encode_texts

    return encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


def _mixed(spark: SparkSession, sf_dir: str, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """The mix at the largest size at which every source has its share, or as large as all documents are."""
    from scanloom.llm.encode import count_tokens
    from scanloom.llm.mixing import mix_sources
    from scanloom.plans.lineage import cut

    docs = count_tokens(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "text", "n_tokens")
    total = None
    if whole:
        docs = cut(docs.drop("text"))
        total = docs.agg(F.sum("n_tokens")).first()[0] or 0
    return mix_sources(docs, "doc_id", "source", "n_tokens", table(spark, sf_dir, "mix_target"), total)


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is used so that the sources have their target shares of all tokens."""
    return _mixed(spark, sf_dir)[0].withColumnRenamed("size", "n_tokens")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's target and actual share of the mix."""
    return _mixed(spark, sf_dir)[1]


def p7_shares_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of a mix as large as all documents, in which sources that are too small fall short, by how much of their share."""
    report = _mixed(spark, sf_dir, whole=True)[1]
    goal = F.sum("target_share").over(Window.partitionBy())
    return report.withColumn("shortfall", F.greatest(F.lit(0.0), F.coalesce(F.col("target_share") / goal - F.col("actual_share"), F.lit(0.0))))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subjects that each document's text deals with."""
    from scanloom.llm.subjects import subject_areas

    return subject_areas(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "subject_label"), table(spark, sf_dir, "subject_area"))


def p8_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus by subject: documents and characters of each subject."""
    found = p8_found(spark, sf_dir)
    sizes = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    sums = found.join(sizes, "doc_id").groupBy("subject").agg(F.count("*").alias("n_documents"), F.sum("n").alias("n_chars"))
    return table(spark, sf_dir, "subject_area").join(sums, "subject", "left").select("subject", "name_cn", F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("n_chars", F.lit(0)).alias("n_chars"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_classes": p2_classes,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_redacted": p4_redacted,
    "p5_found": p5_found,
    "p5_bisect": p5_bisect,
    "p6_ids": p6_ids,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p7_shares_whole": p7_shares_whole,
    "p8_found": p8_found,
    "p8_composition": p8_composition,
}

#: The SQL that both queries on pairs begin with.
_RUNS = r"""
        WITH once AS (
            SELECT DISTINCT id, lower(trim(vultype)) AS kind, regexp_extract_all(source_code, '[A-Za-z0-9_]+') AS t
            FROM vulfile WHERE trim(vultype) <> '' AND source_code IS NOT NULL),
        runs AS (
            SELECT DISTINCT id, kind, lower(t[i]) AS a, lower(t[i + 1]) AS b, lower(t[i + 2]) AS c
            FROM (SELECT id, kind, t, unnest(range(1, len(t) - 1)) AS i FROM once WHERE len(t) >= 30)),
        sizes AS (SELECT id, count(*) AS n FROM runs GROUP BY id),
        met AS (
            SELECT x.id AS id_a, y.id AS id_b, count(*) AS n FROM runs x JOIN runs y USING (kind, a, b, c) WHERE x.id < y.id GROUP BY ALL),
        pairs AS (SELECT id_a, id_b FROM met JOIN sizes p ON p.id = id_a JOIN sizes q ON q.id = id_b WHERE met.n >= 0.6 * (p.n + q.n - met.n))
        """

ORACLE_SQL: dict[str, str] = {
    "p1_found": """
        WITH once AS (
            SELECT id, taskid, lower(trim(vultype)) AS kind, max(max_ccn) AS m, max(CASE WHEN isnan(avgccn) THEN NULL ELSE avgccn END) AS a
            FROM vulfile WHERE taskid IS NOT NULL AND trim(vultype) <> '' GROUP BY ALL),
        ranked AS (SELECT id, row_number() OVER (PARTITION BY taskid, kind ORDER BY m DESC NULLS LAST, a DESC NULLS LAST, id) AS r FROM once)
        SELECT DISTINCT id FROM ranked WHERE r <= 5""",
    "p2_found": _RUNS + "SELECT id_a, id_b FROM pairs",
    "p2_classes": _RUNS
    + """,
        c AS (SELECT DISTINCT v.id, lower(trim(v.vultype)) AS kind, v.source_code FROM vulfile v JOIN sizes s ON s.id = v.id WHERE trim(v.vultype) <> ''),
        k AS (SELECT id, min(id) OVER (PARTITION BY kind, source_code) AS class_id FROM c),
        n AS (SELECT id, count(*) AS n FROM (SELECT id_a AS id FROM pairs UNION ALL SELECT id_b FROM pairs) GROUP BY id)
        SELECT k.id, k.class_id, coalesce(n.n, 0)::BIGINT AS n_links FROM k LEFT JOIN n ON n.id = k.id""",
    "p5_bisect": r"""
        WITH RECURSIVE src AS (SELECT DISTINCT id, source_code AS t FROM vulfile WHERE length(source_code) > 2000),
        lines AS (SELECT id, unnest(string_split(t, chr(10))) AS x, generate_subscripts(string_split(t, chr(10)), 1) AS k FROM src),
        line_ends AS (SELECT id, x, k, sum(length(x) + 1) OVER (PARTITION BY id ORDER BY k)::BIGINT AS p, max(k) OVER (PARTITION BY id) AS last FROM lines),
        gaps AS (SELECT id, unnest(regexp_split_to_array(t, '[ \t]')) AS x, generate_subscripts(regexp_split_to_array(t, '[ \t]'), 1) AS k FROM src),
        gap_ends AS (SELECT id, k, sum(length(x) + 1) OVER (PARTITION BY id ORDER BY k)::BIGINT AS p, max(k) OVER (PARTITION BY id) AS last FROM gaps),
        marks AS (
            SELECT id, length(t)::BIGINT AS n, (SELECT coalesce(list(p), []) FROM line_ends l WHERE l.id = src.id AND k > 1 AND k < last AND regexp_matches(x, '^[ \t\r]*$')) AS blank,
                (SELECT coalesce(list(p), []) FROM line_ends l WHERE l.id = src.id AND k < last) AS feed, (SELECT coalesce(list(p), []) FROM gap_ends g WHERE g.id = src.id AND k < last) AS gap FROM src),
        part AS (
            SELECT id, 0::BIGINT AS a, n AS b FROM marks
            UNION ALL
            SELECT id, unnest([a, c]) AS a, unnest([c, b]) AS b FROM (
                SELECT id, a, b, coalesce(
                    list_sort([{'d': abs(p - mid), 'p': p} FOR p IN blank IF p > mid - q AND p < mid + q])[1].p, list_sort([{'d': abs(p - mid), 'p': p} FOR p IN feed IF p > mid - q AND p < mid + q])[1].p,
                    list_sort([{'d': abs(p - mid), 'p': p} FOR p IN gap IF p > mid - q AND p < mid + q])[1].p, mid) AS c
                FROM (SELECT part.id, a, b, (a + b) // 2 AS mid, (b - a) // 4 AS q, blank, feed, gap FROM part JOIN marks ON marks.id = part.id WHERE b - a > 1800)))
        SELECT id, row_number() OVER (PARTITION BY id ORDER BY a)::INT AS piece_no, greatest(0, a - 200)::INT AS start_pos, b::INT AS end_pos FROM part WHERE b - a <= 1800""",
    "p5_found": r"""
        WITH RECURSIVE src AS (SELECT DISTINCT id, source_code AS t, length(source_code) AS n FROM vulfile WHERE length(source_code) > 2000),
        piece AS (
            SELECT id, t, n, 1 AS piece_no, 0 AS start_pos,
                CASE WHEN n <= 2000 THEN n ELSE coalesce(
                    nullif(length(regexp_extract(left(t, 2000), '^((?s:.*)\n[ \t\r]*\n)', 1)) * (length(regexp_extract(left(t, 2000), '^((?s:.*)\n[ \t\r]*\n)', 1)) > 1000)::INT, 0),
                    nullif(length(regexp_extract(left(t, 2000), '^((?s:.*)\n)', 1)) * (length(regexp_extract(left(t, 2000), '^((?s:.*)\n)', 1)) > 1000)::INT, 0),
                    nullif(length(regexp_extract(left(t, 2000), '^((?s:.*)[ \t])', 1)) * (length(regexp_extract(left(t, 2000), '^((?s:.*)[ \t])', 1)) > 1000)::INT, 0),
                    2000) END AS end_pos
            FROM src
            UNION ALL
            SELECT id, t, n, piece_no + 1, s,
                CASE WHEN n - s <= 2000 THEN n ELSE coalesce(
                    nullif(length(regexp_extract(left(t, s + 2000), '^((?s:.*)\n[ \t\r]*\n)', 1)) * (length(regexp_extract(left(t, s + 2000), '^((?s:.*)\n[ \t\r]*\n)', 1)) > s + 1000)::INT, 0),
                    nullif(length(regexp_extract(left(t, s + 2000), '^((?s:.*)\n)', 1)) * (length(regexp_extract(left(t, s + 2000), '^((?s:.*)\n)', 1)) > s + 1000)::INT, 0),
                    nullif(length(regexp_extract(left(t, s + 2000), '^((?s:.*)[ \t])', 1)) * (length(regexp_extract(left(t, s + 2000), '^((?s:.*)[ \t])', 1)) > s + 1000)::INT, 0),
                    s + 2000) END
            FROM (SELECT *, end_pos - 200 AS s FROM piece WHERE end_pos < n))
        SELECT id, piece_no::INT AS piece_no, start_pos::INT AS start_pos, end_pos::INT AS end_pos FROM piece""",
}
