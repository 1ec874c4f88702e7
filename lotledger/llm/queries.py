"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotledger.llm import alignment, bpe, grades, language, mixing, near_dup, neighbours, pii, preference, prefix_trie, quality_rules, repeats, token_counts
from lotledger.llm.columns import table


def op1_bag_min_hash(spark, sf):
    return near_dup.classes(table(spark, sf, "documents"))


def op2_ordinal_quality(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = grades.learn(docs, grades.grades_of_labels(table(spark, sf, "labels")), grades=3)
    graded = grades.grade_texts(docs, model)
    return graded.select("doc_id", "expected_grade", F.col("tails")[0].alias("p_grade_1"), F.col("tails")[1].alias("p_grade_2"), "kept")


def op3_bpe(spark, sf):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    docs = table(spark, sf, "documents").select("doc_id", "text")
    out = bpe.encode(docs, path, decoded="decoded").drop("text")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), sha(F.array_join("ids", " ")).alias("ids_sha256"), sha(F.col("decoded")).alias("decoded_sha256")
    )


def op4_preference_pairs(spark, sf):
    turns = preference.reply_swaps(table(spark, sf, "conversations"), whole=True)
    return preference.format_pairs(turns, pair="conv_id")


def op5_mixing(spark, sf):
    a = mixing.allot(table(spark, sf, "documents"))
    return a.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op6_kmeans_tree(spark, sf):
    return neighbours.search(table(spark, sf, "embeddings"), F.col("id") % 20 == 0)


def op7_language_mixture(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = language.learn(docs.filter(~held_out))
    found = language.identify(docs.drop("lang"), model)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "languages")


def op8_repeated_passages(spark, sf):
    return repeats.remove_repeats(table(spark, sf, "documents"), with_text=False)


def op9_pii(spark, sf):
    found = pii.find(table(spark, sf, "documents").select("doc_id", "text"))
    n = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    digest = F.sha2(pii.joined(F.col("base_spans")).cast("binary"), 256)
    return found.select("doc_id", *map(n, pii.KINDS), digest.alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


def op10_quality_rules(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return quality_rules.report(docs).select("doc_id", *quality_rules.COUNTS, "base_failed", "kept")


def op11_token_counts(spark, sf):
    import public_tokenizers

    docs = table(spark, sf, "documents").select("doc_id", "text")
    counted = token_counts.prefix_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
    counts = F.col("prefix_tokens")
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return counted.select("doc_id", n_bytes.alias("n_bytes"), token_counts.total(counts).alias("n_tokens"), token_counts.over(counts, F.lit(512)).alias("over_limit"))


def op12_alignment(spark, sf):
    import public_tokenizers

    docs = table(spark, sf, "documents").select("doc_id", "text")
    return alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_prefix_trie(spark, sf):
    return prefix_trie.trie(*prefix_trie.rebuild(table(spark, sf, "conversations")))


QUERIES = {
    "op1_bag_min_hash": op1_bag_min_hash,
    "op2_ordinal_quality": op2_ordinal_quality,
    "op3_bpe": op3_bpe,
    "op4_preference_pairs": op4_preference_pairs,
    "op5_mixing": op5_mixing,
    "op6_kmeans_tree": op6_kmeans_tree,
    "op7_language_mixture": op7_language_mixture,
    "op8_repeated_passages": op8_repeated_passages,
    "op9_pii": op9_pii,
    "op10_quality_rules": op10_quality_rules,
    "op11_token_counts": op11_token_counts,
    "op12_alignment": op12_alignment,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLES = {
    "op5_mixing": r"""
WITH rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), of_source AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source
), weighed AS (
  SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY encode(source) ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM of_source
), levels AS (
  SELECT *, 3 * source_size / weight AS level FROM weighed
), shares AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY level, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(weight) OVER (ORDER BY level, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM levels
), goals AS (
  SELECT source, source_size,
    CASE WHEN share >= level THEN 3.0::DOUBLE * source_size ELSE weight * max(CASE WHEN share < level THEN share END) OVER () END AS target
  FROM shares
), rated AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0 END AS rate,
    ('0x' || md5('mix:' || coalesce('s' || source, 'n'))[1:5])::BIGINT::DOUBLE / 1048576.0 AS u
  FROM goals
), placed AS (
  SELECT doc_id, size, source_size, target, rate, u,
    row_number() OVER (PARTITION BY r.source ORDER BY size, md5(doc_id::VARCHAR)[1:3], doc_id)::DOUBLE AS i
  FROM rows r JOIN rated g ON r.source IS NOT DISTINCT FROM g.source
), counted AS (
  SELECT *, (floor(i * rate + u) - floor((i - 1) * rate + u))::BIGINT AS copies FROM placed
)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM counted""",
    "op4_preference_pairs": """
WITH last AS (
  SELECT conv_id, max((turn, text)) AS m FROM conversations WHERE role = 'assistant' GROUP BY conv_id
), ends AS (
  SELECT a.conv_id, a.m[1] AS last_turn, b.m[2] AS other FROM last a JOIN last b ON b.conv_id = xor(a.conv_id, 1)
), sides AS (
  SELECT conv_id, 'chosen' AS side, turn, role, text FROM conversations
  UNION ALL
  SELECT c.conv_id, 'rejected', turn, role, CASE WHEN turn = last_turn AND role = 'assistant' THEN other ELSE text END
  FROM conversations c JOIN ends e ON e.conv_id = c.conv_id
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, side ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place,
    concat('<|im_start|>', coalesce(role, ''), chr(10), coalesce(text, ''), '<|im_end|>', chr(10)) AS piece FROM sides
), spots AS (
  SELECT conv_id, place, count(*) AS n, count(DISTINCT (coalesce(role, chr(0)), text IS NULL, coalesce(text, ''))) AS kinds FROM placed GROUP BY ALL
), prefix AS (
  SELECT conv_id, coalesce(min(place) FILTER (WHERE n < 2 OR kinds > 1), max(place) + 1) - 1 AS n_prompt_turns FROM spots GROUP BY conv_id
), rest AS (
  SELECT p.*, n_prompt_turns, sum(CASE WHEN place > n_prompt_turns THEN length(piece) ELSE 0 END) OVER (PARTITION BY p.conv_id, side ORDER BY place) AS upto
  FROM placed p JOIN prefix x ON x.conv_id = p.conv_id
), done AS (
  SELECT conv_id, side, max(n_prompt_turns) AS n_prompt_turns,
    coalesce(string_agg(piece, '' ORDER BY place) FILTER (WHERE place <= n_prompt_turns), '') AS prompt,
    coalesce(string_agg(piece, '' ORDER BY place) FILTER (WHERE place > n_prompt_turns), '') AS completion,
    coalesce(string_agg(concat(upto - length(piece) + 13 + length(role), ':', upto), ',' ORDER BY place) FILTER (WHERE place > n_prompt_turns AND role = 'assistant'), '') AS mask
  FROM rest GROUP BY conv_id, side
)
SELECT c.conv_id, c.n_prompt_turns, c.prompt, c.completion AS chosen, c.mask AS chosen_mask, r.completion AS rejected, r.mask AS rejected_mask
FROM done c LEFT JOIN done r ON r.conv_id = c.conv_id AND r.side = 'rejected' WHERE c.side = 'chosen'""",
    "op8_repeated_passages": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), starts AS (
  SELECT r, doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d WHERE len(ws) >= 13
), windows AS (
  SELECT r, doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM starts
), firsts AS (
  SELECT k, min(doc_id) AS earliest FROM windows GROUP BY k
), covered AS (
  SELECT DISTINCT r, unnest(range(i, i + 13)) AS p FROM (SELECT r, i FROM windows w JOIN firsts f ON f.k = w.k WHERE earliest < doc_id)
), spread AS (
  SELECT r, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM d
), kept AS (
  SELECT s.r, string_agg(word, ' ' ORDER BY s.p) AS t, count(*) AS n FROM spread s ANTI JOIN covered c ON c.r = s.r AND c.p = s.p GROUP BY s.r
)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.r = d.r""",
    "op10_quality_rules": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
), grams AS (
  SELECT r, i, array_to_string(ws[i:i + 2], ' ') AS k FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM d WHERE len(ws) >= 3)
), twice AS (
  SELECT r, k FROM grams GROUP BY r, k HAVING count(*) > 1
), hit AS (
  SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT g.r, unnest([i, i + 1, i + 2]) AS p FROM grams g JOIN twice t ON t.r = g.r AND t.k = g.k) GROUP BY r
), counts AS (
  SELECT d.r, doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    len(list_filter(ws, lambda x: regexp_matches(x, '(?s)^[A-Za-z\x{80}-\x{10FFFF}](.*[A-Za-z\x{80}-\x{10FFFF}])?[.,;:]?$'))) AS n_alpha_words,
    len(string_split(text, chr(10))) AS n_lines
  FROM d LEFT JOIN hit ON hit.r = d.r
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 5 * n_symbols > n_words OR 100 * n_alpha_words < 60 * n_words
    OR (n_dup_lines > 2 AND 10 * n_dup_lines > 3 * n_lines)) AS kept FROM judged""",
    "op13_prefix_trie": r"""
WITH turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT DISTINCT c FROM turns
), crc AS (
  SELECT c, c - c % 100 AS opener, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(c::VARCHAR, ''),
    lambda s: [ascii(s)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END)) % 6 AS h
  FROM ids
), rebuilt AS (
  SELECT r.c, 0 AS part, t.p, t.role, t.text FROM crc r JOIN turns t ON t.c = r.opener AND t.p <= r.h
  UNION ALL
  SELECT r.c, 1, t.p, t.role, t.text FROM crc r JOIN turns t ON t.c = r.c AND t.p > r.h
), paths AS (
  SELECT c, list((role, text) ORDER BY part, p) AS l FROM rebuilt GROUP BY c
), convs AS (
  SELECT i.c, coalesce(l, []) AS l FROM ids i LEFT JOIN paths q ON q.c = i.c
), steps AS (
  SELECT c, l, unnest(range(0, len(l) + 1)) AS d FROM convs
), nodes AS (
  SELECT l[1:d] AS path, d, min(c) AS conv_id, count(*) AS n_convs, string_agg(CASE WHEN len(l) = d THEN c::VARCHAR END, ',' ORDER BY c) AS ends
  FROM steps GROUP BY l[1:d], d
), kids AS (
  SELECT path[1:d - 1] AS up, d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL
), valued AS (
  SELECT n.*, coalesce(k.n, 0) AS n_children, CASE WHEN n.d > 0 THEN (n_convs - 1) * length(path[n.d][2]) ELSE 0 END AS own
  FROM nodes n LEFT JOIN kids k ON k.up = n.path AND k.d = n.d + 1
), spread AS (
  SELECT path, n_children, own, unnest(range(0, d + 1)) AS a FROM valued
), sums AS (
  SELECT path[1:a] AS top, a, sum(own) AS saved, count(*) FILTER (WHERE n_children = 0) AS leaves FROM spread GROUP BY ALL
)
SELECT v.conv_id, v.d AS depth, u.conv_id AS parent_conv_id, v.n_convs, v.n_children, s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(coalesce(v.ends, '')) AS ends_sha256
FROM valued v JOIN sums s ON s.top = v.path AND s.a = v.d LEFT JOIN nodes u ON v.d > 0 AND u.d = v.d - 1 AND u.path = v.path[1:v.d - 1]""",
}
