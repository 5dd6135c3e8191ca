"""Queries over the given tables, with their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, host_rules, langid, line_dedup, neighbours, packing, periodic_runs, quality, simhash, token_counts, tool_calls, url_filter, whitening
from .common import BLANKS, fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@query
def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth vector."""
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


SCHEMAS = {
    "search": {"query": {"type": "string", "required": True}, "limit": {"type": "integer", "required": True, "minimum": 1, "maximum": 40}},
    "fetch": {"query": {"type": "string", "required": True}, "mode": {"type": "string", "enum": ["full", "brief"]}},
    "note": {"query": {"type": "string", "required": True}, "limit": {"type": "integer"}, "mode": {"type": "string"}},
}


def chat_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every assistant turn is a call whose arguments hold its text; the turn after it is the result. A call names the
    call two turns before, unless its text's length divides by three."""
    turns = table(spark, sf_dir, "conversations")
    n = F.length("text")
    call = turns.where(F.col("role") == "assistant").select(
        "conv_id", F.col("turn").alias("place"), F.concat(F.lit("call_"), F.col("turn")).alias("call_id"),
        F.element_at(F.array(F.lit("search"), F.lit("fetch"), F.lit("note")), (n % 3 + 1).cast("int")).alias("name"),
        F.concat(
            F.lit('{ "query" : '), F.regexp_replace(F.substr(F.to_json(F.struct(F.col("text").alias("q"))), F.lit(6)), "[}]$", ""),
            F.when(n % 5 == 0, "").when(n % 5 == 1, ', "limit" : "many"').otherwise(F.concat(F.lit(', "limit" : '), (n % 50).cast("string"))),
            F.when(n % 2 == 0, ', "mode" : "brief"').when(n % 7 == 0, ', "mode" : "wide"').otherwise(""), F.lit(" }"),
        ).alias("arguments"),
        F.when(n % 3 != 0, F.concat(F.lit("call_"), F.col("turn") - 2)).alias("parent"),
    )
    result = turns.where((F.col("role") != "assistant") & (F.col("turn") > 0)).select(
        "conv_id", F.col("turn").alias("place"), F.concat(F.lit("call_"), F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return call, result


@query
def op3_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and results of all conversations, linked, ordered, checked and serialised."""
    return tool_calls.link(*chat_tables(spark, sf_dir), SCHEMAS).withColumn("errors", F.array_join("errors", ";"))


ORACLES["op3_tool_calls"] = r"""
WITH RECURSIVE calls AS (
  SELECT conv_id, turn AS place, 'call_' || turn AS call_id, (['search', 'fetch', 'note'])[length(text) % 3 + 1] AS name,
    text, length(text) AS n, CASE WHEN length(text) % 3 <> 0 THEN 'call_' || (turn - 2) END AS parent
  FROM conversations WHERE role = 'assistant'),
results AS (
  SELECT conv_id, turn AS place, 'call_' || (turn - 1) AS call_id, text AS content
  FROM conversations WHERE role <> 'assistant' AND turn > 0),
known AS (
  SELECT c.*, p.call_id AS up FROM calls c LEFT JOIN calls p ON p.conv_id = c.conv_id AND p.call_id = c.parent),
deep AS (
  SELECT conv_id, call_id, CAST(0 AS BIGINT) AS depth FROM known WHERE up IS NULL
  UNION ALL SELECT k.conv_id, k.call_id, d.depth + 1 FROM known k JOIN deep d ON d.conv_id = k.conv_id AND d.call_id = k.up),
said AS (
  SELECT *, n % 5 > 1 AS has_number, n % 5 = 1 AS has_text, n % 2 = 0 OR n % 7 = 0 AS has_mode, n % 2 = 0 AS brief FROM known),
checked AS (
  SELECT s.*, d.depth, r.place AS result_place, r.content,
    list_sort(list_filter(CASE name
      WHEN 'search' THEN [CASE WHEN has_mode THEN 'unexpected:mode' END, CASE WHEN n % 5 = 0 THEN 'missing:limit' END,
        CASE WHEN has_text THEN 'type:limit' END, CASE WHEN has_number AND n % 50 < 1 THEN 'minimum:limit' END,
        CASE WHEN has_number AND n % 50 > 40 THEN 'maximum:limit' END]
      WHEN 'fetch' THEN [CASE WHEN n % 5 > 0 THEN 'unexpected:limit' END, CASE WHEN has_mode AND NOT brief THEN 'enum:mode' END]
      ELSE [CASE WHEN has_text THEN 'type:limit' END] END, lambda x: x IS NOT NULL))
    || CASE WHEN parent IS NOT NULL AND up IS NULL THEN ['unknown_parent'] ELSE [] END AS errs
  FROM said s JOIN deep d USING (conv_id, call_id) LEFT JOIN results r USING (conv_id, call_id))
SELECT conv_id, call_id, place, result_place, row_number() OVER (PARTITION BY conv_id ORDER BY depth, place, call_id) AS position,
  depth, CASE WHEN result_place IS NULL THEN 'waiting' ELSE 'linked' END AS status, array_to_string(errs, ';') AS errors,
  '{"arguments":{' || CASE WHEN has_text THEN '"limit":"many",' WHEN has_number THEN '"limit":' || (n % 50) || ',' ELSE '' END
    || CASE WHEN brief THEN '"mode":"brief",' WHEN has_mode THEN '"mode":"wide",' ELSE '' END
    || '"query":' || CAST(to_json(text) AS VARCHAR) || '},"call_id":"' || call_id || '","errors":' || CAST(to_json(errs) AS VARCHAR)
    || ',"name":"' || name || '","parent":' || coalesce('"' || parent || '"', 'null') || ',"result":'
    || coalesce(CAST(to_json(content) AS VARCHAR), 'null') || ',"status":"'
    || CASE WHEN result_place IS NULL THEN 'waiting' ELSE 'linked' END || '"}' AS json
FROM checked
UNION ALL
SELECT r.conv_id, r.call_id, NULL, r.place, NULL, NULL, 'orphan', '', NULL
FROM results r LEFT JOIN calls c USING (conv_id, call_id) WHERE c.call_id IS NULL
"""


@query
def op4_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and host verdicts of all documents."""
    return host_rules.judge(table(spark, sf_dir, "documents")).drop("host", "host_rate")


ORACLES["op4_host_rules"] = r"""
WITH words AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
windows AS (
  SELECT rid, unnest(range(1, len(ws) - 1)) AS i, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS w
  FROM words WHERE len(ws) > 3),
twice AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, w) AS n FROM windows) WHERE n > 1),
covered AS (
  SELECT rid, CAST(sum(least(3, coalesce(nxt - i, 3))) AS BIGINT) AS n FROM (
    SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM twice) GROUP BY rid),
counted AS (
  SELECT w.rid, doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
      - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
    coalesce(c.n, 0) AS n_repeat_words FROM words w LEFT JOIN covered c USING (rid)),
based AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted),
hosts AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS f FROM based WHERE source IS NOT NULL GROUP BY source),
fit AS (SELECT avg(f / n) AS m, coalesce(var_pop(f / n), 0) AS v, avg(1 / n) AS c FROM hosts),
prior AS (SELECT m, CASE WHEN greatest(v - m * (1 - m) * c, 0) * 1000001 <= m * (1 - m) THEN 1000000.0
    ELSE greatest(m * (1 - m) / greatest(v - m * (1 - m) * c, 0) - 1, 1.0) END AS k FROM fit),
bad AS (SELECT source, (f + m * k) / (n + k) > 0.6 AS failed FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(failed, false) AS kept FROM based LEFT JOIN bad USING (source)
"""


@query
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of all documents and their decoding, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_decode(docs, tokenizer("byte_bpe_50k.tiktoken"), pattern()).drop("text")


@query
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents; one of four folds is held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    model = langid.fit(docs.where(fold("doc_id", 4) != 2), tokenizer("piece_bpe_32k.model"))
    return langid.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


@query
def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all pages; listed are the URLs of pages that show an e-mail address."""
    pages = table(spark, sf_dir, "pages")
    listed = pages.where(F.col("html").rlike("[A-Za-z0-9.]@[A-Za-z0-9]+[.]")).select("url")
    return url_filter.judge(pages, listed, RULES)


ORACLES["op7_urls"] = r"""
WITH cut AS (
  SELECT page_id, html, url, CASE WHEN contains(url, '://') THEN url[strpos(url, '://') + 3:] ELSE '' END AS rest FROM pages),
parts AS (
  SELECT *, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '(?s)^[^?#]*\?([^#]*)', 1), '&'),
      lambda p: p <> '' AND NOT starts_with(p, 'utm_'))), '&') AS query FROM cut),
keyed AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '')
    || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS key FROM parts),
listed AS (SELECT DISTINCT key AS hit FROM keyed WHERE regexp_matches(html, '[A-Za-z0-9.]@[A-Za-z0-9]+[.]') AND key IS NOT NULL),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM keyed)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN hit IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, hit IS NOT NULL AS listed
FROM ruled LEFT JOIN listed ON key = hit
"""


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of all documents; one of five folds is held out."""
    from .common import settle

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stats = settle(quality.with_statistics(docs))
    model = quality.fit(stats.where(fold("doc_id", 5) != 0), table(spark, sf_dir, "labels"))
    scored = quality.score(stats, model)
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 ids."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every line of all documents."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"), pattern())


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: one document in ten, by a hash of its id, goes on from some word in periods."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    bare = F.btrim("text", F.lit(BLANKS))
    words = F.split(bare, r"[\x20\x09-\x0D]+")
    n = F.size(words)
    g = F.floor(h / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    times = F.ceil((n - a) / p).cast("int")
    bent = F.slice(F.concat(F.slice(words, 1, a), F.flatten(F.array_repeat(F.slice(words, a + 1, p), times))), 1, n)
    return docs.select("doc_id", F.when((h % 10 == 0) & (bare != ""), F.concat_ws(" ", bent)).otherwise(F.col("text")).alias("text"))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of periodic words of all documents, the longest one, and digests of all runs and of the texts without repeats."""
    found = periodic_runs.find_runs(planted(table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    found = found.withColumn("best", best)
    length, period = F.col("best.length"), -F.col("best.period")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


#: CRC-32 of the decimal id, bit by bit; a run of ``l + q`` words shows as ``l - 4`` five-word grams that return after ``q`` words.
ORACLES["op11_periodic_runs"] = r"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS raw,
    xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda s, c: list_reduce([xor(s, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)),
      4294967295) AS h FROM documents),
cut AS (SELECT *, len(raw) AS n, CASE WHEN len(raw) > 0 THEN (h // 10) % len(raw) END AS a FROM base),
bent AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM cut),
texts AS (
  SELECT rid, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(range(n), lambda i: raw[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END]) ELSE raw END AS ws FROM bent),
grams AS (
  SELECT rid, n, unnest(range(n - 4)) AS i, unnest(list_transform(range(n - 4), lambda i: array_to_string(ws[i + 1:i + 5], ' '))) AS g FROM texts WHERE n > 5),
pairs AS (
  SELECT x.rid, x.i, y.i - x.i AS q FROM grams x JOIN grams y ON x.rid = y.rid AND x.g = y.g AND y.i > x.i AND (y.i - x.i) * 4 <= x.n),
stretches AS (
  SELECT rid, q, min(i) AS s, count(*) + 4 + q AS l FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS k FROM pairs)
  GROUP BY rid, q, k HAVING count(*) + 4 + q >= greatest(6, 4 * q)),
runs AS (
  SELECT * FROM stretches x WHERE NOT EXISTS (
    SELECT 1 FROM stretches y WHERE y.rid = x.rid AND y.q < x.q AND x.q % y.q = 0 AND y.s <= x.s AND y.s + y.l >= x.s + x.l)),
told AS (
  SELECT rid, count(*) AS n_runs, arg_min(struct_pack(s := s, l := l, q := q), struct_pack(a := -l, b := s, c := q)) AS best,
    string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS listed FROM runs GROUP BY rid),
gone AS (SELECT DISTINCT rid, unnest(range(s + q, s + l)) AS i FROM runs),
words AS (SELECT rid, unnest(range(n)) AS i, unnest(ws) AS w FROM texts WHERE rid IN (SELECT rid FROM runs)),
kept AS (SELECT rid, string_agg(w, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (rid, i) GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.q AS period, 1000 * best.l // best.q AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(t, array_to_string(ws, ' '))) AS collapsed_sha256
FROM texts LEFT JOIN told USING (rid) LEFT JOIN kept USING (rid)
"""


@query
def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without lines that three or more share, but in the last of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cleaned = line_dedup.LineStore().insert(docs).clean(docs)
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op12_line_dedup"] = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT rid, doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM docs),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
shared AS (
  SELECT k, max(doc_id) AS last FROM (SELECT DISTINCT k, doc_id FROM keyed WHERE length(k) >= 20) GROUP BY k HAVING count(*) >= 3),
told AS (SELECT rid, doc_id, i, line, last IS NOT NULL AND doc_id IS DISTINCT FROM last AS gone FROM keyed LEFT JOIN shared USING (k))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM told GROUP BY rid
"""


@query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four first whitened values of all embeddings."""
    model, rows = whitening.fit_transform(table(spark, sf_dir, "embeddings"))
    explained = F.array(*[F.lit(float(e)) for e in model.explained]).cast("array<double>")
    return rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), F.col("deviation").try_cast("long").alias("deviation"),
        "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"))
