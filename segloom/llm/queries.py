"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segloom.llm.alignment import alignment_counts
from segloom.llm.chat import format_conversations, read_back
from segloom.llm.common import table
from segloom.llm.decontaminate import benchmark_hits
from segloom.llm.exact_dedup import exact_groups
from segloom.llm.hilbert_sharding import assign_shards
from segloom.llm.language import identify_languages
from segloom.llm.near_dedup import near_duplicates
from segloom.llm.pieces import encode_checked
from segloom.llm.quality import resample
from segloom.llm.ranked_search import ranked_search
from segloom.llm.repeated_spans import drop_repeated_spans
from segloom.llm.toxicity import score_toxicity
from segloom.llm.warc import archive_folder, read_records, write_archives


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def _held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _held_out()
    scores = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(~held))
    return scores.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return resample(table(spark, sf_dir, "documents"), good)


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return read_back(format_conversations(rows.unionByName(probe))).withColumnRenamed("conv", "conv_id")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_spans(table(spark, sf_dir, "documents"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_checked(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.size("ids").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "score", "other_scores", "round_trip", "others_decode", "ids", "other_edits")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = archive_folder(spark)
    index = write_archives(table(spark, sf_dir, "pages"), folder)
    out = read_records(index, folder)
    return out.select(F.col("id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


def op8_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign_shards(table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "curve")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hit_spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("s")), lambda a, x: F.struct((a["n"] + x * a["s"]).alias("n"), (-a["s"]).alias("s")), lambda a: a["n"])
    return out.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
        "longest_words",
        "longest_item",
        "longest_at",
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), digest_all=True)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = alignment_counts(table(spark, sf_dir, "documents"))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify_languages(docs, docs.where(~_held_out()))
    return out.select("doc_id", _held_out().alias("held_out"), "lang_pred", "score")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_quality": op3_quality,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_pieces": op6_pieces,
    "op7_warc": op7_warc,
    "op8_hilbert_sharding": op8_hilbert_sharding,
    "op9_decontaminate": op9_decontaminate,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_token_alignment": op11_token_alignment,
    "op12_language": op12_language,
    "op13_ranked_search": op13_ranked_search,
}

#: Texts with A to Z lower-cased, in SQL.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: What each half byte adds to a CRC-32 (fixed values).
_HALVES = "[0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]"


def _crc32(bytes_sql: str) -> str:
    """SQL of the CRC-32 of a list of bytes."""
    start = "4294967295::BIGINT"
    halves = f"list_concat([{start}], flatten(list_transform({bytes_sql}, lambda x: [x % 16, x >> 4])))"
    return f"xor({start}, list_reduce({halves}, lambda crc, x: xor(crc >> 4, list_extract({_HALVES}::BIGINT[], CAST(xor(crc % 16, x) + 1 AS BIGINT)))))"


ORACLES: dict[str, str] = {
    # all pairs that share a shingle, and every document that links reach
    "op1_near_dedup": rf"""
        WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
        words AS (SELECT doc_id, len(w) AS words, unnest(w) AS word, unnest(range(len(w))) AS i FROM t),
        s AS (SELECT DISTINCT doc_id, shingle FROM (SELECT *, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS shingle FROM words)
              WHERE i = 0 OR i <= words - 5),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        sized AS (SELECT * FROM s JOIN n USING (doc_id)),
        links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM sized a JOIN sized b ON a.shingle = b.shingle AND a.doc_id < b.doc_id AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
                  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
        edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reached(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM reached r JOIN edges e ON e.a = r.other)
        SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept
        FROM reached LEFT JOIN n USING (doc_id) GROUP BY doc_id
    """,
    # what the template makes of each turn, without tokens
    "op4_chat_formatting": r"""
        WITH t AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(length('<|turn|><|body|><|end|>') + length(regexp_replace(role, '<(~*)\|', '<~\1|', 'g')) + length(regexp_replace(text, '<(~*)\|', '<~\1|', 'g'))) AS BIGINT) AS formatted_chars
        FROM t GROUP BY conv_id
    """,
    # base32 from hexadecimal: 5 digits are 20 bits are 4 letters
    "op7_warc": r"""
        WITH t AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
        g AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, hex, min(page_id) OVER (PARTITION BY html) AS first FROM t)
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (CAST(('0x' || substr(hex, 5 * CAST(i // 4 AS INTEGER) + 1, 5)) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) % 32 + 1, 1)), '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM g
    """,
    # the codes from counts in order (as exact as Spark's quantiles of fewer than 10,000 rows), the
    # curve a level a round: h index, e entry corner, d direction; the fixed lists are those of 3 dimensions
    "op8_hilbert_sharding": rf"""
        WITH RECURSIVE chars AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS source, coalesce(lang, '') AS lang, octet_length(encode(coalesce(text, ''))) + 16 AS size,
                                        CASE WHEN coalesce(text, '') = '' THEN [] ELSE list_transform(string_split(text, ''), lambda c: CAST(unicode(c) AS BIGINT)) END AS points FROM documents),
        bytes AS (SELECT * EXCLUDE (points, text), flatten(list_transform(points, lambda x: CASE WHEN x < 128 THEN [x] WHEN x < 2048 THEN [192 + (x >> 6), 128 + x % 64]
                         WHEN x < 65536 THEN [224 + (x >> 12), 128 + (x >> 6) % 64, 128 + x % 64] ELSE [240 + (x >> 18), 128 + (x >> 12) % 64, 128 + (x >> 6) % 64, 128 + x % 64] END)) AS bytes FROM chars),
        summed AS (SELECT * EXCLUDE (bytes), {_crc32("bytes")} AS crc, {_crc32("list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(unicode(c) AS BIGINT))")} AS id_crc FROM bytes),
        n AS (SELECT count(*) AS n FROM documents),
        marks AS (SELECT DISTINCT size FROM (SELECT size, row_number() OVER (ORDER BY size) AS k FROM summed), n WHERE list_contains(list_transform(range(1, 16), lambda i: (i * n + 15) // 16), k)),
        sizes AS (SELECT size, (SELECT count(*) FROM marks m WHERE m.size < s.size) AS c FROM (SELECT DISTINCT size FROM summed) s),
        tallied AS (SELECT dim, value, m, sum(m) OVER (PARTITION BY dim ORDER BY value) AS upto FROM (SELECT 's' AS dim, source AS value, count(*) AS m FROM summed GROUP BY source UNION ALL SELECT 'l', lang, count(*) FROM summed GROUP BY lang)),
        crossed AS (SELECT dim, value, least(upto * 16 // n, 15) > (upto - m) * 16 // n AS cut FROM tallied, n),
        coded AS (SELECT dim, value, coalesce(count(*) FILTER (cut) OVER (PARTITION BY dim ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM crossed),
        placed AS (SELECT doc_id, s.size, crc, id_crc, CAST(z.c AS INTEGER) AS x, CAST(a.c AS INTEGER) AS y, CAST(b.c AS INTEGER) AS z FROM summed s JOIN sizes z ON z.size = s.size JOIN coded a ON a.dim = 's' AND a.value = source JOIN coded b ON b.dim = 'l' AND b.value = lang),
        walk AS (SELECT DISTINCT x, y, z, 3 AS level, 0 AS h, 0 AS e, 0 AS d FROM placed
                 UNION ALL
                 SELECT x, y, z, level - 1, h * 8 + w, xor(e, ((entry << turn) | (entry >> ((3 - turn) % 3))) & 7), (d + [0, 1, 1, 2, 2, 1, 1, 0][w + 1] + 1) % 3
                 FROM (SELECT *, [0, 0, 0, 3, 3, 6, 6, 5][w + 1] AS entry FROM
                       (SELECT *, [0, 1, 3, 2, 7, 6, 4, 5][(((corner >> turn) | (corner << ((3 - turn) % 3))) & 7) + 1] AS w FROM
                        (SELECT *, (d + 1) % 3 AS turn, xor(((x >> level) & 1) | (((y >> level) & 1) << 1) | (((z >> level) & 1) << 2), e) AS corner FROM walk WHERE level >= 0)))),
        dealt AS (SELECT doc_id, size, crc, h, n, (id_crc + crc) % ((count(*) OVER (PARTITION BY h) - 1) // greatest(1, least(100000, n // 4096)) + 1) AS part FROM placed JOIN walk USING (x, y, z), n WHERE level = -1),
        ranked AS (SELECT *, row_number() OVER (ORDER BY h, part, crc, doc_id) - 1 AS at_row FROM dealt)
        SELECT doc_id, CAST(size AS BIGINT) AS size, crc AS text_crc32, 'rows' AS law, CAST(at_row * 40 // n AS INTEGER) AS shard, CAST(at_row - ((at_row * 40 // n) * n + 39) // 40 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, CAST(h AS BIGINT) AS curve
        FROM ranked
    """,
    # windows of documents and items that are equal; a longest match is a run of them on one diagonal
    "op9_decontaminate": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, row_number() OVER () AS item_row, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        item_words AS (SELECT item, item_row, least(len(w), 10) AS k, unnest(w) AS word, unnest(range(len(w))) AS q, len(w) AS n FROM b),
        item_windows AS (SELECT item, item_row, k, q, words FROM (SELECT *, string_agg(word, ' ') OVER (PARTITION BY item_row ORDER BY q ROWS BETWEEN CURRENT ROW AND k - 1 FOLLOWING) AS words FROM item_words) WHERE q <= n - k),
        doc_words AS (SELECT doc_id, k, unnest(w) AS word, unnest(range(len(w))) AS p, len(w) AS n FROM d JOIN (SELECT DISTINCT k FROM item_words) ON k <= len(w)),
        doc_windows AS (SELECT doc_id, k, p, words FROM (SELECT *, string_agg(word, ' ') OVER (PARTITION BY doc_id, k ORDER BY p ROWS BETWEEN CURRENT ROW AND k - 1 FOLLOWING) AS words FROM doc_words) WHERE p <= n - k),
        same AS (SELECT doc_id, item, item_row, k, p, q FROM doc_windows JOIN item_windows USING (k, words)),
        hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS place FROM same) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, item FROM same) GROUP BY doc_id),
        stretches AS (SELECT doc_id, item, count(*) + any_value(k) - 1 AS words, min(p) AS place FROM (SELECT *, p - row_number() OVER (PARTITION BY doc_id, item_row, p - q ORDER BY p) AS run FROM same) GROUP BY doc_id, item, item_row, p - q, run),
        longest AS (SELECT doc_id, words, item, place FROM stretches QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY words DESC, place, item) = 1)
        SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated,
               coalesce(words, 0) AS longest_words, longest.item AS longest_item, coalesce(place, 0) AS longest_at
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN longest USING (doc_id)
    """,
    "op10_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW g AS (PARTITION BY norm)
    """,
    # every pair of an item and a document with a common term
    "op13_ranked_search": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, unnest(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        q AS (SELECT item_id, term, count(*) AS times FROM b GROUP BY ALL),
        s AS (SELECT count(*) FILTER (len(w) > 0) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM d),
        tf AS (SELECT doc_id, term, n, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term, len(w) AS n FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
        w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf, s GROUP BY term),
        impacts AS (SELECT doc_id, term, (1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * docs) // terms))) AS impact FROM tf, s),
        scores AS (SELECT item_id, doc_id, CAST(sum(times * weight * impact) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN impacts USING (term) GROUP BY ALL HAVING score > 0)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores
        QUALIFY rank <= 20
    """,
}
