"""The registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywick.llm import chat_format, chunk_dedup, decontaminate, impact_search, license_scan, mixture, ngram_join
from tallywick.llm import ordinal_quality, simhash_trie, syncmers, token_binary, turn_repair, twins, warc_derive
from tallywick.session import Scratch, table

#: Grade (2: good) and least probability of it at which a document is selected.
GOOD, MIN_TAIL = 2, 0.5
#: The id that ends a document in the token files.
END_ID = 2
#: Share of all tokens that the mixture keeps, and the target weights of some languages and topics.
KEEP_SHARE = 0.8
TARGETS = {"lang": {"en": 0.4, "de": 0.2}, "topic": {"table": 0.02, "symbols": 0.01}}


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its near-duplicate class: five-word grams, Jaccard 0.8 or more."""
    return ngram_join.ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one made of control strings, read back from its formatted string."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.range(2, numPartitions=1).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    made = chat_format.format_conversations(turns.unionByName(control))
    back = made.select("conv_id", chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.read_loss_text(F.col("formatted"), F.col("spans")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    every = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(every, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


_OP2_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
    length(regexp_replace(role, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g')) AS role_chars,
    length(regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g')) AS text_chars FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  (5 + sum(text_chars + CASE WHEN before IS NULL THEN 16 + role_chars WHEN before = role THEN 13 ELSE 21 + role_chars END))::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id"""


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the licence templates that their lines, paragraphs or whole texts match."""
    return license_scan.license_matches(table(spark, sf_dir, "documents")).withColumn("best_dice", F.round("best_dice", 6))


def _op4_sql() -> str:
    quoted = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in license_scan.TEMPLATES.items())
    grams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return rf"""
WITH t AS (SELECT template, {grams} AS g FROM
    (SELECT template, string_split(trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM (VALUES {quoted}) v(template, text))),
s AS (SELECT doc_id, unnest(list_distinct(string_split(coalesce(text, ''), chr(10)) || string_split(regexp_replace(regexp_replace(coalesce(text, ''), '[ \t\r\n]+', ' ', 'g'), '([.;:!?]) ', '\1' || chr(10), 'g'), chr(10)) || string_split_regex(coalesce(text, ''), '{license_scan.PARTED}') || [coalesce(text, '')])) AS segment FROM documents),
b AS (SELECT row_number() OVER () AS k, doc_id, {grams} AS g FROM
    (SELECT doc_id, string_split(trim(regexp_replace(lower(segment), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM s) WHERE len(w) >= 2),
d AS (SELECT k, doc_id, template, 2.0 * len(list_intersect(b.g, t.g)) / (len(b.g) + len(t.g)) AS dice FROM b, t
      WHERE len(b.g) BETWEEN 0.8 / 1.2 * len(t.g) - 1e-9 AND 1.2 / 0.8 * len(t.g) + 1e-9),
m AS (SELECT doc_id, template, dice FROM d WHERE dice >= 0.8 QUALIFY row_number() OVER (PARTITION BY k ORDER BY dice DESC, template) = 1)
SELECT doc_id, template, count(*) AS n_segments, round(max(dice), 6) AS best_dice FROM m GROUP BY ALL"""


def op6_warc_derive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metadata and conversion record of every page, with digests of header and block."""
    made = warc_derive.derive(warc_derive.responses_of_pages(table(spark, sf_dir, "pages")), ["page_id"])
    return made.select("page_id", "kind", "record_id", "refers_to", "target_uri", "source_digest", F.col("n_links").cast("long").alias("n_links"), F.length("block").cast("long").alias("block_chars"), "block_digest", F.sha2("header", 256).alias("header_sha256"))


def _op6_sql() -> str:
    """Written on its own: entities by their names' list, links by cases, header lines spelt out."""
    names = ", ".join(f"'{k}': chr({v})" for k, v in [*sorted(name2codepoint.items()), ("apos", 39)])
    nl = "chr(13) || chr(10)"

    def entities(text: str) -> str:
        code = "CASE WHEN p[2] IN ('x', 'X') THEN ('0x' || regexp_extract(p, '^#[xX]([0-9a-fA-F]{1,6});', 1))::INT ELSE regexp_extract(p, '^#([0-9]{1,7});', 1)::INT END"
        numeric = f"CASE WHEN ({code}) BETWEEN 1 AND 55295 OR ({code}) BETWEEN 57344 AND 1114111 THEN chr({code}) ELSE chr(65533) END"
        shown = f"""CASE WHEN regexp_matches(p, '^#([0-9]{{1,7}}|[xX][0-9a-fA-F]{{1,6}});') THEN {numeric} || substr(p, instr(p, ';') + 1)
          WHEN regexp_matches(p, '^[A-Za-z][A-Za-z0-9]{{1,7}};') AND m[split_part(p, ';', 1)] IS NOT NULL THEN m[split_part(p, ';', 1)] || substr(p, instr(p, ';') + 1)
          ELSE '&' || p END"""
        return f"string_split({text}, '&')[1] || array_to_string(list_transform(string_split({text}, '&')[2:], lambda p: {shown}), '')"

    def urn(text: str) -> str:
        d = f"md5({text})"
        return "'<urn:uuid:' || " + " || '-' || ".join(f"substr({d}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + " || '>'"

    block = "address|article|aside|blockquote|body|br|dd|div|dl|dt|figure|footer|form|h1|h2|h3|h4|h5|h6|head|header|hr|html|li|main|nav|ol|p|pre|section|table|tbody|td|th|thead|title|tr|ul"
    bare = "regexp_replace(regexp_replace(payload, '(?s)<!--.*?-->', '', 'g'), '(?is)<(script|style)([ \t\r\n][^>]*)?>.*?</(script|style)[ \t\r\n]*>', '', 'g')"
    shown = f"regexp_replace(regexp_replace({bare}, '(?i)</?({block})([^a-z0-9_>][^>]*)?>', chr(10), 'g'), '(?i)</?[a-z][^>]*>|<![^>]*>', '', 'g')"
    lines = f"regexp_replace(replace({entities('shown')}, chr(160), ' '), '[ \t\r\f]+', ' ', 'g')"
    text = f"trim(regexp_replace({lines}, ' ?\\n[ \\n]*', chr(10), 'g'), ' ' || chr(10))"
    host = "regexp_extract(target_uri, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*')"
    folder = "coalesce(nullif(regexp_extract(target_uri, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/)([^?#]*/)?', 0), ''), " + host + " || '/')"
    link = f"""CASE WHEN regexp_matches(x, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN x WHEN starts_with(x, '//') THEN split_part(target_uri, '//', 1) || x
      WHEN starts_with(x, '/') THEN {host} || x WHEN x = '' THEN split_part(target_uri, '#', 1) WHEN starts_with(x, '#') THEN split_part(target_uri, '#', 1) || x
      WHEN starts_with(x, '?') THEN split_part(split_part(target_uri, '#', 1), '?', 1) || x ELSE {folder} || x END"""
    title = f"trim(regexp_replace({entities("regexp_extract(payload, '(?is)<title(?:[ \t\r\n][^>]*)?>(.*?)</title', 1)")}, '[ \t\r\n]+', ' ', 'g'))"
    source = "['Content-Type: text/html; charset=utf-8', 'Content-Length: ' || strlen(payload)]"
    fields = [("WARC-Type", "kind"), ("WARC-Record-ID", "record_id"), ("WARC-Date", "'1970-01-01T00:00:00Z'"), ("WARC-Refers-To", "refers_to"), ("WARC-Refers-To-Target-URI", "target_uri"), ("WARC-Target-URI", "target_uri"), ("WARC-Source-Payload-Digest", "source_digest"), ("WARC-Source-Status", "'HTTP/1.1 200 OK'"), ("WARC-Source-Content-Type", "'text/html; charset=utf-8'"), ("WARC-Block-Digest", "'sha256:' || sha256(block)"), ("Content-Type", "mime"), ("Content-Length", "strlen(block)::VARCHAR"), ("WARC-Source-Header", "heads[1]"), ("WARC-Source-Header", "heads[2]")]
    header = f"'WARC/1.1' || {nl} || " + " || ".join(f"'{k}: ' || {v} || {nl}" for k, v in fields) + f" || {nl}"
    return f"""
WITH names AS MATERIALIZED (SELECT MAP {{{names}}} AS m),
r AS (SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload,
    {urn("concat_ws(chr(10), 'response', page_id::VARCHAR, url)")} AS refers_to, m FROM pages, names),
s AS (SELECT *, 'sha256:' || sha256(payload) AS source_digest, {source} AS heads, {shown} AS shown,
    regexp_extract_all(payload, '(?i)<a[ \t\r\n](?:[^>]*?[ \t\r\n])?href[ \t\r\n]*=[ \t\r\n]*("[^"]*"|''[^'']*''|[^ \t\r\n"''>]+)', 1) AS raw FROM r),
l AS (SELECT *, list_transform(raw, lambda y: trim(regexp_replace({entities("trim(y, '\"''')")}, '[\t\r\n]', '', 'g'))) AS links FROM s),
b AS (SELECT page_id, target_uri, refers_to, source_digest, heads, len(links) AS n_links, 'metadata' AS kind, 'application/warc-fields' AS mime,
    'title: ' || {title} || {nl} || 'http-status: HTTP/1.1 200 OK' || {nl} || 'http-header: ' || heads[1] || {nl} || 'http-header: ' || heads[2] || {nl}
      || coalesce(array_to_string(list_transform(links, lambda x: 'outlink: ' || {link} || {nl}), ''), '') AS block FROM l
  UNION ALL SELECT page_id, target_uri, refers_to, source_digest, heads, len(links), 'conversion', 'text/plain; charset=utf-8', {text} FROM l),
n AS (SELECT *, {urn("concat_ws(chr(10), kind, refers_to)")} AS record_id FROM b)
SELECT page_id, kind, record_id, refers_to, target_uri, source_digest, n_links::BIGINT AS n_links, length(block)::BIGINT AS block_chars,
  'sha256:' || sha256(block) AS block_digest, sha256({header}) AS header_sha256 FROM n"""


def tokenizer_path() -> str:
    """The byte-level BPE file; it is installed on every machine, so a task asks for its own place."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _tokenizer() -> token_binary.PieceTokenizer:
    return token_binary.tokenizer_of(tokenizer_path())


def op3_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum in the range-coded id files, read back from them."""
    return token_files(spark, table(spark, sf_dir, "documents"))


def token_files(spark: SparkSession, docs: DataFrame) -> DataFrame:
    path = f"{Scratch(spark, 'token-ids').root}/frames"
    token_binary.write_ids(docs, path, _tokenizer, END_ID)
    return token_binary.read_ids(spark.read.parquet(path))


def op5_chunk_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages that documents share with other documents, by content-defined chunks."""
    return chunk_dedup.repeated_spans(table(spark, sf_dir, "documents"))


def op7_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the ordinal classifier selects, with their expected grade and tail probability."""
    docs = table(spark, sf_dir, "documents")
    model = ordinal_quality.fit(docs, table(spark, sf_dir, "labels"), ordinal_quality.rated_grade())
    scored = ordinal_quality.score(docs.select("doc_id", "text"), model, grade=GOOD, min_tail=MIN_TAIL)
    return scored.filter("keep").select("doc_id", F.round("expected_grade", 6).alias("expected_grade"), F.round("tail_probability", 6).alias("tail_probability"), "keep")


def mixture_dims() -> dict[str, Column]:
    return {"source": F.col("source"), "lang": F.col("lang"), "topic": mixture.text_topic()}


def op8_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents drawn after raking token weights to source, language and topic marginals."""
    docs = table(spark, sf_dir, "documents")
    drawn = mixture.mix(docs, mixture_dims(), mixture.word_count(), keep_share=KEEP_SHARE, targets=TARGETS)
    return drawn.select("doc_id", "source", "lang", F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"))


def _op8_sql() -> str:
    """The same raking, unrolled over more rounds than it needs, with c from the sorted cells in closed form."""
    dims, steps, last = ("source", "lang", "topic"), [], "r0"
    for i in range(1, 48 * 3 + 1):
        d = dims[(i - 1) % 3]
        steps.append(f"r{i} AS MATERIALIZED (SELECT source, lang, topic, tokens, t_source, t_lang, t_topic, coalesce(raked * t_{d} / nullif(sum(raked) OVER (PARTITION BY {d}), 0), 0) AS raked FROM {last})")
        last = f"r{i}"
    def aims(d: str) -> str:
        named = TARGETS.get(d, {})
        given = f"CASE {d} {' '.join(f"WHEN '{k}' THEN {v}" for k, v in named.items())} END::DOUBLE" if named else "NULL::DOUBLE"
        return f"""m_{d} AS (SELECT {d}, CASE WHEN g IS NOT NULL THEN g / CASE WHEN taken > 1 OR rest = 0 THEN taken ELSE 1 END ELSE greatest(1 - taken, 0) * p / rest END AS t_{d}
  FROM (SELECT {d}, g, p, coalesce(sum(g) OVER (), 0) AS taken, coalesce(sum(CASE WHEN g IS NULL THEN p END) OVER (), 0) AS rest
    FROM (SELECT {d}, {given} AS g, power(sum(tokens)::DOUBLE, 0.5) AS p FROM cells GROUP BY {d})))"""

    shares = ", ".join(map(aims, dims))
    return f"""
WITH keyed AS (
  SELECT doc_id, source AS source0, lang AS lang0, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang,
    CASE WHEN contains(coalesce(text, ''), ' | ') THEN 'table'
         WHEN regexp_matches(coalesce(text, ''), '[%$#&*]{{3}}') THEN 'symbols'
         WHEN length(coalesce(text, '')) < 1000 THEN 'short prose'
         WHEN length(coalesce(text, '')) < 5000 THEN 'prose' ELSE 'long prose' END AS topic,
    CASE WHEN trim(coalesce(text, '')) = '' THEN 0 ELSE len(string_split_regex(trim(text), '[ \n\t\r]+')) END AS tokens
  FROM documents),
cells AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens FROM keyed GROUP BY ALL),
{shares},
r0 AS MATERIALIZED (SELECT c.*, t_source, t_lang, t_topic, tokens / (SELECT sum(tokens) FROM cells)::DOUBLE AS raked
  FROM cells c JOIN m_source USING (source) JOIN m_lang USING (lang) JOIN m_topic USING (topic)),
{', '.join(steps)},
w AS MATERIALIZED (SELECT source, lang, topic, tokens, coalesce(raked * (SELECT sum(tokens) FROM cells) / nullif(tokens, 0), 1.0) AS weight FROM {last}),
o AS (SELECT *, sum(tokens) OVER s - tokens AS capped, sum(tokens * weight) OVER (ORDER BY weight, source, lang, topic) AS rest, sum(tokens) OVER () AS every
      FROM w WINDOW s AS (ORDER BY weight DESC, source DESC, lang DESC, topic DESC)),
c AS (SELECT ({KEEP_SHARE} * every - capped) / rest AS c FROM o WHERE ({KEEP_SHARE} * every - capped) / rest * weight <= 1 ORDER BY weight DESC, source DESC, lang DESC, topic DESC LIMIT 1)
SELECT k.doc_id, k.source0 AS source, k.lang0 AS lang, round(w.weight, 6) AS weight, round(least(1.0, w.weight * c.c), 6) AS probability
FROM keyed k JOIN w USING (source, lang, topic), c
WHERE ('0x' || substr(md5('17:' || k.doc_id), 1, 13))::UBIGINT::DOUBLE / 4503599627370496.0 < least(1.0, w.weight * c.c)"""


def op9_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint beside those of its edited text and of the next document."""
    return syncmers.fingerprint_edits(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items whose tokens their tiles cover to half or more."""
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("coverage", F.round("coverage", 6))


def op11_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's SimHash and component: three-word shingles, links at three or fewer bits."""
    return simhash_trie.near_duplicates(table(spark, sf_dir, "documents"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by its rows' checksums, with its faults and cheapest repair."""
    return turn_repair.repair_conversations(turn_repair.damaged(table(spark, sf_dir, "conversations")))


def op13_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item's ten highest-scoring documents."""
    return impact_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_PLAIN = (op1_ngram_jaccard_join, op2_chat_format, op3_token_binary, op4_license_scan, op5_chunk_repeats, op6_warc_derive, op7_ordinal_quality, op8_source_mixture, op9_syncmer_fingerprints, op10_decontaminate)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (*_PLAIN, op11_simhash_trie, op12_turn_repair, op13_impact_search)}


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_format": _OP2_SQL, "op4_license_scan": _op4_sql(), "op6_warc_derive": _op6_sql(), "op8_source_mixture": _op8_sql(), "op12_turn_repair": twins.repair_sql(), "op13_impact_search": twins.search_sql()}
