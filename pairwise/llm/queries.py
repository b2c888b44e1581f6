"""The dealt operators applied to their whole tables, one query each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwise.llm import (
    langid,
    lines,
    merkle,
    mixing,
    near,
    neighbours,
    packing,
    passages,
    quality,
    secrets,
    trie,
    vectors,
    warc,
)
from pairwise.sources.tables import read_table


def op2_fair_queue_mix(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op1_one_bit_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    vectors = read_table(spark, folder, "embeddings")
    return neighbours.nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


def op3_line_runs(spark: SparkSession, folder: str) -> DataFrame:
    marked = lines.mark(read_table(spark, folder, "documents"))
    gone = F.col("gone")
    begun = F.filter(gone, lambda x: ~F.array_contains(gone, x - 1))
    return marked.select(
        F.col("row.doc_id").alias("doc_id"), F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.size(gone).cast("long").alias("n_removed"), F.size(begun).cast("long").alias("n_runs"),
        F.sha2(F.coalesce(lines.remaining_text(), F.lit("")), 256).alias("kept_sha256"))


def op4_prob_min_hash(spark: SparkSession, folder: str) -> DataFrame:
    return near.near_duplicates(read_table(spark, folder, "documents"))


def op5_chunked_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(spark, read_table(spark, folder, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op6_curve_packing(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, folder, "documents")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False).drop("ids")


def op7_cross_polytope_links(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.near_equal(read_table(spark, folder, "embeddings"), threshold=0.93)


def op8_prefix_free_parse(spark: SparkSession, folder: str) -> DataFrame:
    cut = passages.remove_repeats(read_table(spark, folder, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


def op9_subword_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    labels = read_table(spark, folder, "labels").where(~quality.held_out(F.col("doc_id")))
    model = quality.fit(docs, labels.select("doc_id", F.col("quality").alias("label")))
    return docs.select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), quality.score(model, F.col("text")).alias("score")
    ).withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op10_owned_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan(read_table(spark, folder, "documents"))
    base = F.filter("spans", lambda x: x["kind"] < 3)

    def count(kind: int):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")

    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secrets.span_text(base), 256).alias("base_sha256"), secrets.span_text(F.col("spans")).alias("spans"),
        count(3).alias("n_owned"), F.size(F.filter("spans", lambda x: x["live"])).cast("long").alias("n_live"))


def op11_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    turns = trie.ordered(read_table(spark, folder, "conversations"))
    shared = F.crc32(F.col("conv_id").cast("string")) % 9
    return trie.trie(trie.spliced(turns, 5, shared)).drop("last_bytes")


def op12_slot_pivot_manifest(spark: SparkSession, folder: str) -> DataFrame:
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = F.translate("text", capitals, capitals.lower())
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    found = merkle.verify_documents(
        read_table(spark, folder, "documents"), F.when(tampered, lowered).otherwise(F.col("text")))
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"),
                        "folded_root", "verified")


def op13_cross_parsing(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    held_out = langid.held_out(F.col("doc_id"))
    model = langid.fit(docs.where(~held_out).select("doc_id", "text", "lang"))
    told = docs.select("doc_id", held_out.alias("held_out"), langid.identify(model, F.col("text")).alias("told"))
    return told.select("doc_id", "held_out", F.col("told.lang").alias("lang_pred"), F.col("told.score").alias("score"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_one_bit_neighbours": op1_one_bit_neighbours,
    "op2_fair_queue_mix": op2_fair_queue_mix,
    "op3_line_runs": op3_line_runs,
    "op4_prob_min_hash": op4_prob_min_hash,
    "op5_chunked_warc": op5_chunked_warc,
    "op6_curve_packing": op6_curve_packing,
    "op7_cross_polytope_links": op7_cross_polytope_links,
    "op8_prefix_free_parse": op8_prefix_free_parse,
    "op9_subword_quality": op9_subword_quality,
    "op10_owned_secrets": op10_owned_secrets,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_slot_pivot_manifest": op12_slot_pivot_manifest,
    "op13_cross_parsing": op13_cross_parsing,
}


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text: eight shifts for every character."""
    steps = "list_transform(string_split(" + text + ", ''), lambda ch: [ord(ch), -1, -1, -1, -1, -1, -1, -1, -1])"
    return (f"xor(list_reduce([4294967295::BIGINT] || flatten({steps})::BIGINT[], lambda crc, x: CASE WHEN x >= 0 "
            "THEN xor(crc, x) ELSE xor(crc >> 1, 3988292384 * (crc & 1)) END), 4294967295)")


#: levels of a tree in SQL: 16^6 rows a source
LEVELS = 6


def _tree_sql(name: str, source: str, group: str) -> str:
    """Levels ``name``_0.. over ``source`` (group, no, digest), each grouping 16 of the one below, and ``name``_top."""
    parts = [f"{name}_0 AS (SELECT *, count(*) OVER (PARTITION BY {group}) AS size FROM {source})"]
    for i in range(LEVELS):
        parts.append(
            f"{name}_{i + 1} AS (SELECT {group}, no // 16 AS no, sha256(string_agg(digest, '' ORDER BY no)) AS digest, "
            f"(max(size) + 15) // 16 AS size FROM {name}_{i} WHERE size > 1 GROUP BY {group}, no // 16)")
    tops = [f"SELECT {group}, digest FROM {name}_{i} WHERE size = 1" for i in range(LEVELS + 1)]
    parts.append(f"{name}_top AS ({' UNION ALL '.join(tops)})")
    for i in range(LEVELS):
        parts.append(
            f"{name}_s{i} AS (SELECT m.{group} AS g, m.no, string_agg(o.digest, '' ORDER BY o.no) FILTER (o.no < m.no) AS bef, "
            f"string_agg(o.digest, '' ORDER BY o.no) FILTER (o.no > m.no) AS aft FROM {name}_{i} m JOIN {name}_{i} o "
            f"ON m.{group} IS NOT DISTINCT FROM o.{group} AND m.no // 16 = o.no // 16 WHERE m.size > 1 GROUP BY ALL)")
    return ", ".join(parts)


def _folds_sql(name: str, start: str, group: str, number: str) -> tuple[str, str]:
    """Follows ``folded`` and collects siblings level by level, from rows ``start``."""
    parts, before = [], start
    for i in range(LEVELS):
        here = f"{name}_fold{i}"
        parts.append(
            f"{here} AS (SELECT b.* REPLACE (CASE WHEN s.no IS NULL THEN b.folded ELSE "
            f"sha256(coalesce(s.bef, '') || b.folded || coalesce(s.aft, '')) END AS folded, "
            f"b.sibs || coalesce(s.bef, '') || coalesce(s.aft, '') AS sibs) FROM {before} b LEFT JOIN {name}_s{i} s "
            f"ON s.g IS NOT DISTINCT FROM b.{group} AND s.no = b.{number} // {16 ** i})")
        before = here
    return ", ".join(parts), before


def _manifest_sql() -> str:
    def coded(value: str) -> str:
        return f"coalesce(octet_length(encode({value}::VARCHAR))::VARCHAR || ':' || {value}::VARCHAR, '-')"

    others = " || ".join(coded(c) for c in ("doc_id", "source", "lang", "n_chars"))
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    low, low_end = _folds_sql("t", "begun", "source", "nod")
    high, high_end = _folds_sql("u", "joined", "one", "nou")
    return f"""
WITH hashed AS (
  SELECT doc_id, source, sha256({others} || {coded("text")}) AS leaf,
         CASE WHEN {_crc32("doc_id::VARCHAR")} % 5 = 0 THEN sha256({others} || {coded(lower)}) END AS changed
  FROM documents),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS no FROM hashed),
t_in AS (SELECT source, no, leaf AS digest FROM leaves),
{_tree_sql("t", "t_in", "source")},
u_in AS (SELECT 1 AS one, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS no, digest FROM t_top),
{_tree_sql("u", "u_in", "one")},
begun AS (SELECT doc_id, source, leaf, no AS nod, coalesce(changed, leaf) AS folded, '' AS sibs FROM leaves),
{low},
ranked AS (SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS nou FROM t_top),
joined AS (SELECT d.*, r.subroot, r.nou, 1 AS one FROM {low_end} d JOIN ranked r ON d.source IS NOT DISTINCT FROM r.source),
{high}
SELECT doc_id, leaf, subroot, u_top.digest AS root, sha256(sibs) AS proof_sha256, folded AS folded_root,
       folded = u_top.digest AS verified
FROM {high_end}, u_top
"""


SQL: dict[str, str] = {
    # windows of one, two and three non-blank lines; a short one counts when it has fifty words
    "op3_line_runs": r"""
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
raw AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos FROM split),
seq AS (
  SELECT doc_id, pos, line, len(regexp_extract_all(line, '\S+')) AS words,
         row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS no
  FROM raw WHERE regexp_matches(line, '\S')),
wins AS (
  SELECT doc_id, no, pos, line AS l1, words AS w1, pos AS a1,
         lead(line, 1) OVER d AS l2, lead(pos, 1) OVER d AS a2, words + lead(words, 1) OVER d AS w2,
         lead(line, 2) OVER d AS l3, lead(pos, 2) OVER d AS a3
  FROM seq WINDOW d AS (PARTITION BY doc_id ORDER BY no)),
flags AS (
  SELECT *, row_number() OVER (PARTITION BY l1 ORDER BY doc_id, no) > 1 AND w1 >= 50 AS c1,
         l2 IS NOT NULL AND row_number() OVER (PARTITION BY l1, l2 ORDER BY doc_id, no) > 1 AND w2 >= 50 AS c2,
         l3 IS NOT NULL AND row_number() OVER (PARTITION BY l1, l2, l3 ORDER BY doc_id, no) > 1 AS c3
  FROM wins),
gone AS (
  SELECT doc_id, a1 AS pos FROM flags WHERE c1 OR c2 OR c3
  UNION SELECT doc_id, a2 FROM flags WHERE c2 OR c3
  UNION SELECT doc_id, a3 FROM flags WHERE c3),
kept AS (
  SELECT r.doc_id, string_agg(r.line, chr(10) ORDER BY r.pos) AS text
  FROM raw r LEFT JOIN gone g ON r.doc_id = g.doc_id AND r.pos = g.pos WHERE g.pos IS NULL GROUP BY r.doc_id),
counts AS (
  SELECT doc_id, count(*) AS n_removed,
         sum(CASE WHEN before IS NULL OR before <> pos - 1 THEN 1 ELSE 0 END) AS n_runs
  FROM (SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM gone) GROUP BY doc_id)
SELECT s.doc_id, CAST(coalesce(len(s.ls), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(c.n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(c.n_runs, 0) AS BIGINT) AS n_runs,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM split s LEFT JOIN counts c ON s.doc_id = c.doc_id LEFT JOIN kept k ON s.doc_id = k.doc_id
""",
    # all pairs that share a shingle, the sum of the definition for each ratio of counts, and reachability
    "op4_prob_min_hash": r"""
WITH RECURSIVE tokens AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[^\x09-\x0D\x20]+') AS ws FROM documents WHERE text IS NOT NULL),
spots AS (
  SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM tokens WHERE len(ws) > 0),
shingled AS (
  SELECT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS s, count(*) AS w FROM spots GROUP BY ALL),
sizes AS (SELECT doc_id, sum(w) AS total FROM shingled GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS da, b.doc_id AS db, CAST(a.w AS DOUBLE) AS x, CAST(b.w AS DOUBLE) AS y
  FROM shingled a JOIN shingled b ON a.s = b.s AND a.doc_id < b.doc_id),
mass AS (SELECT da, db, sum(x) AS sx, sum(y) AS sy FROM shared GROUP BY da, db),
classes AS (SELECT da, db, x, y, x / y AS r, count(*) AS n FROM shared GROUP BY da, db, x, y),
inner_sums AS (
  SELECT i.da, i.db, i.r, sum(greatest(j.x, i.r * j.y) * j.n) AS inside
  FROM (SELECT DISTINCT da, db, r FROM classes) i JOIN classes j ON i.da = j.da AND i.db = j.db GROUP BY ALL),
sims AS (
  SELECT c.da, c.db, sum(c.n * c.x / (sa.total - m.sx + c.r * (sb.total - m.sy) + s.inside)) AS sim
  FROM classes c JOIN inner_sums s ON c.da = s.da AND c.db = s.db AND c.r = s.r
  JOIN mass m ON c.da = m.da AND c.db = m.db
  JOIN sizes sa ON sa.doc_id = c.da JOIN sizes sb ON sb.doc_id = c.db GROUP BY c.da, c.db),
links AS (SELECT da AS a, db AS b FROM sims WHERE sim >= 0.8 UNION SELECT db, da FROM sims WHERE sim >= 0.8),
reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents
  UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen)
SELECT node AS doc_id, min(seen) AS class_id, node = min(seen) AS kept FROM reach GROUP BY node
""",
    # a path is the list of its turns' hashes; ancestors are its prefixes
    "op11_conversation_trie": f"""
WITH turns AS (
  SELECT conv_id, md5(octet_length(encode(coalesce(role, '')))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
         octet_length(encode(coalesce(text, ''))) AS b,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS no
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(k ORDER BY no) AS ks, list(b ORDER BY no) AS bs FROM turns GROUP BY conv_id),
cut AS (SELECT *, {_crc32("conv_id::VARCHAR")} % 9 AS h FROM own),
built AS (
  SELECT c.conv_id, coalesce(o.ks[1:c.h], []) || c.ks[c.h + 1:] AS ks, coalesce(o.bs[1:c.h], []) || c.bs[c.h + 1:] AS bs
  FROM cut c LEFT JOIN own o ON o.conv_id = c.conv_id - c.conv_id % 5),
paths AS (
  SELECT conv_id, len(ks) AS length, unnest(range(0, len(ks) + 1)) AS depth, ks, bs FROM built),
keyed AS (
  SELECT conv_id, depth, depth = length AS ends, md5(array_to_string(ks[1:depth], ' ')) AS path,
         CASE WHEN depth > 0 THEN md5(array_to_string(ks[1:depth - 1], ' ')) END AS up,
         CASE WHEN depth > 0 THEN bs[depth] ELSE 0 END AS b
  FROM paths),
nodes AS (
  SELECT path, any_value(up) AS up, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         any_value(b) AS b, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ended
  FROM keyed GROUP BY path),
kids AS (SELECT up AS path, count(*) AS n FROM nodes WHERE up IS NOT NULL GROUP BY up),
full_nodes AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN kids k ON n.path = k.path),
above AS (
  SELECT x.path, x.n_convs, x.n_children, x.b, k.path AS top
  FROM full_nodes x JOIN keyed k ON k.conv_id = x.conv_id AND k.depth <= x.depth),
sums AS (
  SELECT top AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * b) AS saved
  FROM above GROUP BY top)
SELECT x.conv_id, x.depth, p.conv_id AS parent_conv_id, x.n_convs, x.n_children,
       CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(x.ended) AS ends_sha256
FROM full_nodes x JOIN sums s ON s.path = x.path LEFT JOIN full_nodes p ON p.path = x.up
""",
    "op12_slot_pivot_manifest": _manifest_sql(),
}
