"""The registered queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyard.llm import byte_bpe, chat_format, html_extract, lang_id, lexical_search, lm_scoring, packing, quality_rules, secret_scan, source_audit, url_gbt
from panelyard.llm._common import held_out, table
from panelyard.llm.exact_dedup import exact_duplicates
from panelyard.llm.minhash_dedup import near_duplicates


URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_gbt.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85, side=10, width=3)


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return lm_scoring.score_documents(table(spark, sf_dir, "documents"), held_out("doc_id", 7, 2), public_tokenizers.path("word_bpe_49k.json"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.sql(
        r"""SELECT cast(-7 AS BIGINT) AS conv_id, cast(turn AS BIGINT) AS turn, role, r'\### Assistant: </turn> ok' AS text
        FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)"""
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    chats = chat_format.format_chats(rows.withColumn("parts", chat_format.text_parts(F.col("text"))))
    back = chats.select("conv_id", chat_format.parse(F.col("formatted")).alias("turns"), chat_format.under_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"), "formatted")
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(text.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed", "clean_word_chars"
    )


def op8_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    test = held_out("doc_id", 5, 0)
    prototypes = lang_id.train(docs.filter(~test))
    return lang_id.identify(docs, prototypes).select("doc_id", test.alias("held_out"), "lang_pred", "score")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return byte_bpe.decode(encoded, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096)


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    of_kind = lambda kind: F.size(F.filter("plain", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select(
        "doc_id", *map(of_kind, secret_scan.KINDS), F.sha2(listed("plain").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"), "n_layers", "n_unopened"
    )


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(table(spark, sf_dir, "documents"))


SQL_OP5 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(t, r)),
e AS (SELECT *, length(role) + length(text) + 2 * length(role || text) - length(replace(role || text, '\', '')) - length(replace(role || text, '<', '')) + 23 AS chars FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
  coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss, sum(chars) AS chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM g
"""

SQL_OP6 = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

#: The rules of quality_rules, on lines and words unnested.
SQL_OP7 = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
d AS (SELECT *, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM t),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM d, unnest(range(1, len(w) - 6)) AS u(i)),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
repeated AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, unnest(range(0, 8)) AS u(k) GROUP BY doc_id),
line AS (SELECT doc_id, l, list_filter(string_split_regex(l, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
  length(regexp_replace(l, '[\\x20\\x09-\\x0D]+', '', 'g')) AS chars,
  coalesce(h[i], false) AND ((coalesce(h[i - 1], false) AND (coalesce(h[i + 1], false) OR coalesce(h[i - 2], false))) OR (coalesce(h[i + 1], false) AND coalesce(h[i + 2], false))) AS menu
  FROM (SELECT doc_id, lines[i] AS l, list_concat([false, false], h) AS h, i + 2 AS i FROM
    (SELECT doc_id, lines, list_transform(lines, lambda x: regexp_matches(x, '%s') AND NOT regexp_matches(x, '%s')) AS h FROM d), unnest(range(1, len(lines) + 1)) AS u(i))),
judged AS (SELECT doc_id, chars, menu
  OR len(list_filter(w, lambda x: x IN (%s))) * 5 >= len(w)
  OR len(list_filter(w, lambda x: contains(x, '://') OR contains(x, 'www.'))) * 3 >= len(w)
  OR (length(l) - length(regexp_replace(l, '[#*$%%&|<>]', '', 'g')) >= 3 AND (length(l) - length(regexp_replace(l, '[#*$%%&|<>]', '', 'g'))) * 2 > len(w))
  OR ((length(l) - length(replace(l, '!!', ''))) // 2 + (length(l) - length(replace(l, '??', ''))) // 2) * 4 >= len(w)
  OR (chars >= 8 AND (length(l) - length(regexp_replace(l, '[A-Z]', '', 'g'))) * 2 > chars)
  OR %s AS fails FROM line),
per AS (SELECT doc_id, count(*) FILTER (fails) AS removed, coalesce(sum(chars) FILTER (NOT fails), 0) AS clean FROM judged GROUP BY doc_id),
b AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%%&|<>]', '', 'g')) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  coalesce(r.n, 0) AS n_repeat_words, coalesce(p.removed, 0) AS n_lines_removed, CAST(coalesce(p.clean, 0) AS BIGINT) AS clean_word_chars
  FROM d LEFT JOIN repeated r USING (doc_id) LEFT JOIN per p USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 2 * (word_chars - clean_word_chars) <= word_chars AS kept FROM b
""" % (
    quality_rules.SHORT.replace("'", "''"),
    quality_rules.ENDED.replace("'", "''"),
    ", ".join(f"'{s}'" for s in quality_rules.SEPARATORS),
    " OR ".join("contains(lower(l), '" + p.replace("'", "''") + "')" for p in quality_rules.BOILERPLATE),
)

#: Terms as in lexical_search; the logarithm is the only number that is not whole.
SQL_OP12 = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
d AS (SELECT row_number() OVER () AS r, doc_id, w, CAST(len(w) AS BIGINT) AS n FROM words WHERE len(w) > 0),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM d),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY r, term),
i AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE text IS NOT NULL) GROUP BY item_id, term),
idf AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, s GROUP BY term, docs),
scored AS (SELECT item_id, r, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)))) AS BIGINT) AS score
  FROM i JOIN idf USING (term) JOIN p USING (term) JOIN d USING (r), s GROUP BY item_id, r),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored JOIN d USING (r) WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 20
"""

SQL_OP13 = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS c FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
l AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
gn AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 5)) // (coalesce(gn.n, 0) + 5 * l.v) AS p,
  1 + (1000000000::HUGEINT * (k.c + 5)) // (l.n + 5 * l.v) AS q
  FROM g JOIN kept k ON k.lang = g.lang JOIN l ON l.lang = g.lang LEFT JOIN gn ON gn.lang = g.lang AND gn.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(f.value, 0) AS value FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN f ON f.lang = g.lang AND f.source = g.source AND f.item = h.source),
a AS (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE c > 0 AND p > q),
ranked AS (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM a)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_minhash": op2_minhash,
    "op3_html_extract": op3_html_extract,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_chat_format": op5_chat_format,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_lang_id": op8_lang_id,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_packing": op10_packing,
    "op11_secret_scan": op11_secret_scan,
    "op12_lexical_search": op12_lexical_search,
    "op13_source_audit": op13_source_audit,
}
SQL = {"op5_chat_format": SQL_OP5, "op6_exact_dedup": SQL_OP6, "op7_quality_rules": SQL_OP7, "op12_lexical_search": SQL_OP12, "op13_source_audit": SQL_OP13}
