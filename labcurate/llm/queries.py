"""The registered queries of this subpackage: opN_<name> over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labcurate.llm import bpe, chat_format, fill_middle, html_main, hyperminhash, langid, mips, packing, pii, prefix_trie, toxicity, url_filter, vector_dedup
from labcurate.llm.common import held_out, table

#: The rules of query op10.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    return chat_format.digests(chat_format.format_trees(chat_format.turns_to_tree(turns.unionByName(extra))))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, keep_ids=False)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = langid.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return df.select("doc_id", held_out(df.doc_id).alias("held_out"), "lang_pred", "score")


def op4_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = toxicity.detect(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return df.select("doc_id", held_out(df.doc_id).alias("held_out"), "score", "predicted")


def op6_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_anisotropic_mips(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return mips.search(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op9_linear_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES, url_filter.train(spark))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(fill_middle.transform(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find(table(spark, sf_dir, "documents")))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(*prefix_trie.rebuilt(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_language_id": op3_language_id,
    "op4_html_main_text": op4_html_main_text,
    "op5_toxicity": op5_toxicity,
    "op6_vector_dedup": op6_vector_dedup,
    "op7_hyperminhash": op7_hyperminhash,
    "op8_anisotropic_mips": op8_anisotropic_mips,
    "op9_linear_grouping": op9_linear_grouping,
    "op10_url_filter": op10_url_filter,
    "op11_fill_middle": op11_fill_middle,
    "op12_pii": op12_pii,
    "op13_prefix_trie": op13_prefix_trie,
}
_ESCAPED = r"regexp_replace({}, '([<\[]/?)(\\*)(s>|INST\])', '\1\\\2\3', 'g')"
_OP1 = f"""
WITH turns AS (
    SELECT conv_id, turn, role, text FROM conversations
    UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '{CONTROL_TEXT}'), (-7, 1, 'assistant', '{CONTROL_TEXT}')) v(conv_id, turn, role, text)
), filled AS (SELECT conv_id, turn, role AS given, text AS said, coalesce(role, '') AS role, coalesce(text, '') AS text FROM turns),
whole AS (
    SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, given NULLS FIRST, said NULLS FIRST) AS turns,
        coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, given NULLS FIRST, said NULLS FIRST) FILTER (role = 'assistant'), '') AS loss,
        sum(length('{chat_format.TURN}{chat_format.HEADER}{chat_format.END}') + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")}))::BIGINT AS formatted_chars
    FROM filled GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM whole"""
#: (a, b): links both ways -> the smallest node that each can reach.
_REACHED = "reached(node, least) AS (SELECT a, b FROM links UNION SELECT r.node, l.b FROM reached r JOIN links l ON l.a = r.least)"
_OP6 = f"""
WITH RECURSIVE v AS (
    SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
    WHERE list_inner_product(x.e, y.e) / sqrt(list_inner_product(x.e, x.e)) / sqrt(list_inner_product(y.e, y.e)) >= {vector_dedup.COSINE}::DOUBLE
), {_REACHED}, n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a), c AS (SELECT node, min(least) AS least FROM reached GROUP BY node)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(least(vec_id, c.least), vec_id) AS component_id, vec_id = coalesce(least(vec_id, c.least), vec_id) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.node = vec_id"""
_OP7 = f"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words
), content AS (SELECT md5(list_sort(s)::VARCHAR) AS c, any_value(s) AS s, len(any_value(s)) AS n FROM sets WHERE len(s) > 0 GROUP BY 1),
shingles AS (SELECT c, n, unnest(s) AS x FROM content),
common AS (SELECT l.c AS a, r.c AS b, l.n AS na, r.n AS nb, count(*) AS n FROM shingles l JOIN shingles r ON l.x = r.x AND l.c <> r.c AND 100 * least(l.n, r.n) >= 85 * greatest(l.n, r.n) GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 100 * n >= 85 * (na + nb - n)), {_REACHED},
named AS (SELECT doc_id, md5(list_sort(s)::VARCHAR) AS c FROM sets WHERE len(s) > 0),
pairs AS (SELECT node, least FROM reached UNION SELECT c, c FROM content),
ids AS (SELECT p.node AS c, min(n.doc_id) AS component_id FROM pairs p JOIN named n ON n.c = p.least GROUP BY 1)
SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(i.component_id, s.doc_id) AS component_id, s.doc_id = coalesce(i.component_id, s.doc_id) AS kept
FROM sets s LEFT JOIN named n ON n.doc_id = s.doc_id LEFT JOIN ids i ON i.c = n.c"""
_OP11 = """
WITH t AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents
), h AS (
    SELECT doc_id, text, u, len(u) AS n, ('0x' || x[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || x[9:16])::BIGINT % (len(u) + 1) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || x[17:24])::BIGINT % 100 >= 90 THEN 'plain' WHEN ('0x' || x[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM t
), c AS (
    SELECT doc_id, text, n, form, array_to_string(u[:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:], '') AS s FROM h
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM c"""
#: One step of CRC-32 by bits, over the bytes of a decimal number.
_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)), lambda c, d: list_reduce(list_concat([xor(c, d)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT)"
_OP13 = f"""
WITH own AS (
    SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS t FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), h AS (SELECT conv_id, t, {_CRC} % 6 AS h FROM own),
whole AS (SELECT h.conv_id, list_concat(coalesce(b.t[:h.h], []), h.t[h.h + 1:]) AS t FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 100),
steps AS (SELECT conv_id, len(t) AS m, d, sha256(t[:d]::VARCHAR) AS k, sha256(t[:d - 1]::VARCHAR) AS up, CASE WHEN d > 0 THEN length(t[d].t) ELSE 0 END AS chars FROM whole, unnest(range(len(t) + 1)) r(d)),
nodes AS (
    SELECT d, k, any_value(CASE WHEN d > 0 THEN up END) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE m = d), '') AS ends FROM steps GROUP BY d, k
), kids AS (SELECT d - 1 AS d, up AS k, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1, 2),
full_nodes AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids c ON c.d = n.d AND c.k = n.k),
inside AS (SELECT DISTINCT a.d AS top_d, a.k AS top_k, b.d, b.k FROM steps a JOIN steps b ON a.conv_id = b.conv_id AND b.d >= a.d),
sums AS (SELECT top_d AS d, top_k AS k, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * chars)::BIGINT AS saved_tokens FROM inside JOIN full_nodes USING (d, k) GROUP BY 1, 2)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, sha256(n.ends) AS ends_sha256
FROM full_nodes n JOIN sums s ON s.d = n.d AND s.k = n.k LEFT JOIN nodes p ON p.d = n.d - 1 AND p.k = n.up"""
#: The others' models, tokenizers and plans cannot be stated in SQL; tests hold them against plain versions.
ORACLE_SQL: dict[str, str] = {"op1_chat_format": _OP1, "op6_vector_dedup": _OP6, "op7_hyperminhash": _OP7, "op11_fill_middle": _OP11, "op13_prefix_trie": _OP13}
