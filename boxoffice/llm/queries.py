"""Registered queries over the test tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxoffice.llm import bpe, chat, compression, decontaminate, language, lexical, periodic, pii, rules, simhash, tokenfile, toxicity, urls
from boxoffice.llm.labelled import fold
from boxoffice.llm.staging import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers ``build(spark, read)``; ``read`` gives a table by name."""

    def register(build):
        QUERIES[name] = lambda spark, sf_dir: build(spark, lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))
        if sql:
            ORACLES[name] = sql
        return build

    return register


@query("op10_simhash")
def op10(spark, read):
    return simhash.near_duplicates(read("documents"))


# the same word pattern for both engines; A-Z only are lower-cased
SQL_WORDS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query(
    "op8_decontaminate",
    f"""
    WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {SQL_WORDS.format("text")} AS w FROM benchmark WHERE text IS NOT NULL),
    bw AS (
      SELECT DISTINCT item_id, least(len(w), 10) AS l, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS k
      FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0
    ),
    d AS (SELECT doc_id, {SQL_WORDS.format("coalesce(text, '')")} AS w FROM documents),
    dw AS (
      SELECT doc_id, i, l, array_to_string(w[i:i + l - 1], ' ') AS k
      FROM d, (SELECT DISTINCT l FROM bw) AS x, unnest(range(1, len(w) - l + 2)) AS u(i)
    ),
    h AS (SELECT DISTINCT doc_id, i, l, item_id FROM dw JOIN bw USING (l, k)),
    p AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM (SELECT DISTINCT doc_id, i, l FROM h), unnest(range(0, l)) AS v(j) GROUP BY doc_id),
    n AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id)), ',') AS names FROM h GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
      sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
    FROM d LEFT JOIN p USING (doc_id) LEFT JOIN n USING (doc_id)
    """,
)
def op8(spark, read):
    found = decontaminate.find_passages(read("documents"), read("benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op6_bpe")
def op6(spark, read):
    found = bpe.encoded(read("documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ids=False)
    return found.drop("ids")


@query("op4_quality")
def op4(spark, read):
    model = compression.fitted(read("documents"), read("labels"), "quality", fold("doc_id", 4) != 2)
    scores = compression.scored(read("documents").select("doc_id", "text"), model)
    return scores.select(
        "doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= compression.KEEP).cast("int").alias("predicted")
    )


@query("op3_surrogates")
def op3(spark, read):
    return pii.surrogates(read("documents").select("doc_id", "text"), key="test tables")


@query("op2_toxicity")
def op2(spark, read):
    model = toxicity.fitted(read("documents"), read("labels"), "toxic", fold("doc_id", 5) != 0)
    scores = toxicity.scored(read("documents"), model)
    return scores.select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages"
    )


SITES = [
    (urls.ALLOW, "com/"),
    (urls.BLOCK, "example.com/en/"),
    (urls.ALLOW, "www.example.com/en/"),
    (urls.BLOCK, "net/es/"),
    (urls.BLOCK, "net/fr/"),
]


@query(
    "op1_url_filter",
    f"""
    WITH site(verdict, rule) AS (VALUES {", ".join(map(repr, SITES))}),
    rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
    part AS (
      SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
    )
    SELECT page_id, host, path, max_by(rule, length(rule)) AS rule, coalesce(max_by(verdict, length(rule)), 'allow') AS verdict
    FROM part LEFT JOIN site
      ON ends_with('.' || host, '.' || split_part(rule, '/', 1)) AND starts_with(path, substr(rule, strpos(rule, '/')))
    GROUP BY page_id, host, path
    """,
)
def op1(spark, read):
    return urls.judged(read("pages"), [urls.Rule.site(verdict, name) for verdict, name in SITES])


@query(
    "op7_chat",
    """
    WITH c AS (
      SELECT conv_id, list({'r': role, 't': text} ORDER BY turn, role, text) AS turns
      FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL) GROUP BY conv_id
    ),
    k AS (SELECT min(conv_id) AS conv_id, turns, count(*) AS n_equal FROM c GROUP BY turns),
    p AS (SELECT DISTINCT turns[1:i] AS turns FROM k, unnest(range(1, len(turns))) AS u(i))
    SELECT conv_id, CAST(len(turns) AS BIGINT) AS n_turns, n_equal,
      array_to_string(['<|im_start|>' || replace(x.r, '<|', '< |') || chr(10) || replace(x.t, '<|', '< |') || '<|im_end|>' || chr(10) for x in turns], '') AS text
    FROM k WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.turns = k.turns)
    """,
)
def op7(spark, read):
    return chat.formatted(read("conversations"))


@query("op9_quality_rules")
def op9(spark, read):
    model = rules.fitted(read("documents"), read("labels"), "quality", F.lit(True))
    return rules.judged(read("documents"), model)


@query("op5_token_files")
def op5(spark, read):
    path = new_path(spark, "tokens")
    tokenfile.write(read("documents"), public_tokenizers.path("byte_bpe_50k.json"), path, added=True)
    return tokenfile.read(spark, path, ids=False).drop("ids")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)``: every tenth document, by the hash of its id, repeats itself from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), 1))
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), chosen.alias("w"))
    rows = rows.withColumn("n", F.size("w")).withColumn("a", F.expr("CASE WHEN n > 0 THEN g % n END"))
    rows = rows.withColumn("p", F.expr("1 + (n - a) DIV (3 + g % 8)"))
    planted = "array_join(transform(w, (x, i) -> CASE WHEN i < a THEN x ELSE w[CAST(a + (i - a) % p AS INT)] END), ' ')"
    return rows.select("doc_id", F.expr(f"CASE WHEN n > 0 THEN {planted} ELSE text END").alias("text"))


@query("op11_runs")
def op11(spark, read):
    found = periodic.without_runs(with_planted_runs(read("documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    rows = found.withColumn("best", best).withColumn("lines", F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        F.col("best.n").alias("length"),
        (-F.col("best.p")).alias("period"),
        F.expr("1000 * best.n DIV -best.p").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query("op13_language")
def op13(spark, read):
    docs = read("documents")
    found = language.predicted(docs, language.fitted(docs, fold("doc_id", 4) != 2))
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


@query(
    "op12_lexical_search",
    f"""
    WITH d AS (SELECT doc_id, {SQL_WORDS.format("text")} AS w FROM documents WHERE text IS NOT NULL),
    s AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
    t AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) GROUP BY doc_id, n, term),
    q AS (SELECT DISTINCT item_id, unnest({SQL_WORDS.format("text")}) AS term FROM benchmark WHERE text IS NOT NULL),
    f AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM t, s GROUP BY term, n_docs),
    r AS (
      SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
      FROM q JOIN f USING (term) JOIN t USING (term), s GROUP BY item_id, doc_id
    ),
    o AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM r WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10
    """,
)
def op12(spark, read):
    return lexical.search(spark, lexical.build(read("documents")), read("benchmark"))
