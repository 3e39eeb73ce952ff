"""The registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bwt, embed_graph, media, mixing, packing, phrases, quality, repair, sharding, simhash, substring, token_store, toxicity
from .common import table
from .learning import fold
from .tokens import tokenizer_path

#: Target shares; sources are to weigh the same, each: whichever the table has (SOURCES are those of the given tables, for the SQL).
LANGUAGES = {"en": 0.55, "fr": 0.15, "de": 0.15, "es": 0.15}
TOPICS = {"list": 0.1, "loud": 0.05, "prose": 0.85}
SOURCES = {f"src{i}": 0.05 for i in range(20)}


def topic(text="text"):
    """A coarse topic of the whole text: lists, shouting, prose."""
    t = F.coalesce(F.col(text), F.lit(""))
    return F.when(F.contains(t, F.lit(" | ")), "list").when(F.contains(t, F.lit("!!")), "loud").otherwise("prose")


def word_tokens(text="text"):
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 4) == 2
    model = quality.train(docs, table(spark, sf_dir, "labels"), ~held)
    return quality.score(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.find_passages(table(spark, sf_dir, "documents"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_store.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.media_features(media.store_media(table(spark, sf_dir, "documents"))))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def mixed(docs: DataFrame) -> DataFrame:
    with_topic = docs.withColumn("topic", topic())
    return mixing.mix(with_topic, {"source": None, "lang": LANGUAGES, "topic": TOPICS}, word_tokens())


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixed(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    return rows.select("doc_id", "source", "lang", "topic", "tokens", F.round("probability", 6).alias("probability"), "kept")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_by_bytes(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "group_id")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_embedding_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_graph.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 3) == 1
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held)
    return toxicity.score(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.audit(repair.damage(table(spark, sf_dir, "conversations")))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents").select("lang", "text"))


def op13_bwt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bwt.remove_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_quality, op2_substring, op3_token_store, op4_media, op5_simhash, op6_mixing, op7_sharding, op8_packing, op9_embedding_graph, op10_toxicity, op11_repair, op12_phrases, op13_bwt, pipeline)}


def _mixing_sql() -> str:
    """The same raking, each sweep and margin a table of its own."""
    margins = {"source": SOURCES, "lang": LANGUAGES, "topic": TOPICS}
    values = lambda wanted: ", ".join(f"('{k}', {v})" for k, v in wanted.items())
    sql = [
        r"""docs AS (SELECT doc_id, source, lang, CASE WHEN contains(coalesce(text, ''), ' | ') THEN 'list' WHEN contains(coalesce(text, ''), '!!') THEN 'loud' ELSE 'prose' END AS topic,
          CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS tokens FROM documents)""",
        "cells AS (SELECT source, lang, topic, CAST(sum(tokens) AS BIGINT) AS tokens FROM docs GROUP BY ALL HAVING sum(tokens) > 0)",
    ]
    last = "cells"
    for name, wanted in margins.items():
        sql.append(f"want_{name} AS (SELECT * FROM (VALUES {values(wanted)}) t(k, raw))")
        sql.append(f"raw_{name} AS (SELECT c.*, w.raw AS r, sum(tokens) OVER (PARTITION BY {name}) AS has FROM {last} c LEFT JOIN want_{name} w ON w.k = c.{name})")
        sql.append(f"full_{name} AS (SELECT *, coalesce(r, {1.0 - sum(wanted.values())!r} * has / sum(CASE WHEN r IS NULL THEN tokens END) OVER ()) AS f FROM raw_{name})")
        sql.append(f"goal_{name} AS (SELECT * EXCLUDE (r, has, f), f / sum(f * tokens / has) OVER () * sum(tokens) OVER () AS goal_{name} FROM full_{name})")
        last = f"goal_{name}"
    sql.append(f"w0 AS (SELECT *, CAST(tokens AS DOUBLE) AS weight FROM {last})")
    n = 0
    for _ in range(mixing.SWEEPS):
        for name in margins:
            sql.append(f"w{n + 1} AS MATERIALIZED (SELECT * REPLACE (weight * goal_{name} / sum(weight) OVER (PARTITION BY {name}) AS weight) FROM w{n})")
            n += 1
    sql.append(f"p AS (SELECT source, lang, topic, (weight / tokens) / max(weight / tokens) OVER () AS probability FROM w{n})")
    return "WITH " + ",\n".join(sql) + """
    SELECT d.doc_id, d.source, d.lang, d.topic, d.tokens, round(coalesce(p.probability, 1.0), 6) AS probability,
      CAST(('0x' || substr(md5('mix:' || CAST(d.doc_id AS VARCHAR)), 1, 13)) AS BIGINT) / 4503599627370496.0 < coalesce(p.probability, 1.0) AS kept
    FROM docs d LEFT JOIN p ON p.source IS NOT DISTINCT FROM d.source AND p.lang IS NOT DISTINCT FROM d.lang AND p.topic = d.topic"""


def _repair_sql() -> str:
    """The same repair, from the last row to the first: of each state of the grammar the least (cost, edits) to the end, one row a step."""
    step = lambda x: f"CASE WHEN {x} & 1 = 1 THEN xor({x} >> 1, 3988292384) ELSE {x} >> 1 END"
    crc = f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: {step('x')})), 4294967295)"
    white = r"[^\x20\x09-\x0D]"
    far = "{'c': 1000000000, 'a': '', 't': []::VARCHAR[]}"
    # a way on: cost, edit, the rows it gives, and where it leads; ways that aren't there are dropped
    way = lambda when, cost, edit, rows, to: f"CASE WHEN {when} THEN {{'c': {cost} + {to}.c, 'a': '{edit}' || {to}.a, 't': {rows} || {to}.t}} END"
    goes = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    row = {}
    for p in range(4):
        ways = [way("true", 4, "D", "[]::VARCHAR[]", f"w{p}")]
        for c, q in goes[p].items():
            ways.append(way(f"NOT gone AND left(role, 1) = '{c}'", "cut", "K", "[role || ':' || text]", f"w{q}"))
            if c != "s":
                ways.append(way("NOT gone", "3 + cut", "R", f"['{'user' if c == 'u' else 'assistant'}:' || text]", f"w{q}"))
        row[p] = f"list_min(list_filter([{', '.join(ways)}], lambda x: x IS NOT NULL))"
    insert = lambda p, cols: {q: f"list_min([{cols}{q}, {{'c': 3 + {cols}{p}.c, 'a': 'I' || {cols}{p}.a, 't': ['{'assistant:' if p == 3 else 'user:'}'] || {cols}{p}.t}}])" for q in ((2,) if p == 3 else (0, 1, 3))}
    first, second, third = insert(3, "r"), insert(2, "x"), insert(3, "y")
    closed = lambda body: (
        f"SELECT conv_id, i, y0 AS w0, y1 AS w1, {third[2]} AS w2, y3 AS w3 FROM (SELECT conv_id, i, {second[0]} AS y0, {second[1]} AS y1, x2 AS y2, {second[3]} AS y3 FROM (SELECT conv_id, i, r0 AS x0, r1 AS x1, {first[2]} AS x2, r3 AS x3 FROM ({body})))"
    )
    return rf"""WITH RECURSIVE k AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS how FROM k),
e AS (SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN how = 3 THEN [0, 1] ELSE [0] END) AS copy FROM d WHERE how <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS seen FROM e),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '{white}') THEN 1 WHEN seen THEN 2 WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 3 ELSE 0 END AS fault, lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS earlier FROM n),
r AS (SELECT conv_id, i, role, text, fault IN (1, 2) AS gone, CASE WHEN fault = 3 THEN 3 ELSE 0 END AS cut FROM f),
s AS (SELECT conv_id, count(i) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
  count(*) FILTER (earlier IS NOT NULL AND left(earlier, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN f USING (conv_id) GROUP BY conv_id),
w AS ({closed(f"SELECT conv_id, rows AS i, {{'c': 0, 'a': '', 't': []::VARCHAR[]}} AS r0, {far} AS r1, {far} AS r2, {{'c': 0, 'a': '', 't': []::VARCHAR[]}} AS r3 FROM s")}
  UNION ALL {closed(f"SELECT w.conv_id, w.i - 1 AS i, {row[0]} AS r0, {row[1]} AS r1, {row[2]} AS r2, {row[3]} AS r3 FROM w JOIN r ON r.conv_id = w.conv_id AND r.i = w.i")})
SELECT conv_id, CAST(gaps AS BIGINT) AS gaps, blank, duplicate, truncated, illegal, CAST(w0.c AS BIGINT) AS cost, w0.a AS audit, sha256(array_to_string(w0.t, chr(10))) AS repaired_sha256 FROM w JOIN s USING (conv_id) WHERE w.i = 0"""


#: The same by counting every phrase.
_PHRASES_SQL = r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
g AS (SELECT lang, k, words[i : i + k - 1] AS words FROM (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(words) >= k)),
f AS MATERIALIZED (SELECT lang, k, words, count(*) AS a FROM g GROUP BY ALL),
t AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, words, a FROM f WHERE k >= 2 AND a >= 100),
cut AS (SELECT c.*, l.a AS l, r.a AS r, t.n, h, (1000::HUGEINT * c.a * t.n) // (l.a::HUGEINT * r.a) AS score FROM (SELECT *, unnest(range(1, k)) AS h FROM c) c JOIN t USING (lang) JOIN f l ON l.lang = c.lang AND l.words = c.words[1 : h] JOIN f r ON r.lang = c.lang AND r.words = c.words[h + 1 : c.k]),
worst AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, h) = 1),
inner_ AS (SELECT DISTINCT lang, words[i : i + m - 1] AS words, a FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c))),
held AS (SELECT lang, words, max(a) AS a FROM inner_ GROUP BY ALL),
kept AS (SELECT w.*, array_to_string(w.words, ' ') AS phrase FROM worst w LEFT JOIN held h ON h.lang = w.lang AND h.words = w.words WHERE h.a IS NULL OR h.a < w.a)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) WHERE rank <= 2000"""


#: The same by every string of 100 bytes, as hexadecimal text.
_BWT_SQL = """WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h, row_number() OVER (ORDER BY doc_id, text) AS no FROM documents),
w AS (SELECT no, i, md5_number(substring(h, 2 * i + 1, 200)) AS s FROM (SELECT no, h, unnest(range(0, len(h) // 2 - 99)) AS i FROM d)),
again AS (SELECT no, i FROM w QUALIFY row_number() OVER (PARTITION BY s ORDER BY no, i) > 1),
edge AS (SELECT no, i, i > coalesce(lag(i) OVER (PARTITION BY no ORDER BY i) + 100, -1) AS new FROM again),
run AS (SELECT no, min(i) AS a, max(i) + 100 AS z FROM (SELECT no, i, sum(CAST(new AS INT)) OVER (PARTITION BY no ORDER BY i) AS run FROM edge) GROUP BY no, run),
gap AS (SELECT no, a, z, coalesce(lag(z) OVER (PARTITION BY no ORDER BY a), 0) AS before FROM run),
cut AS (SELECT no, sum(z - a) AS removed, count(*) AS spans, string_agg(substring(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substring(any_value(h), 2 * max(z) + 1) AS kept FROM gap JOIN d USING (no) GROUP BY no)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN cut USING (no)"""


ORACLE_SQL = {"op6_mixing": _mixing_sql(), "op11_repair": _repair_sql(), "op12_phrases": _PHRASES_SQL, "op13_bwt": _BWT_SQL}
