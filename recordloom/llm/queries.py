"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm import (
    bpe_codec,
    decontaminate,
    divergence,
    embedding_dedup,
    hard_negatives,
    near_dup,
    packing,
    quality,
    sharding,
    token_counts,
    token_store,
    toxicity,
    url_filter,
)
from recordloom.llm.common import new_path, read_table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), 512)


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_path(spark, "token-store")
    token_store.write_store(read_table(spark, sf_dir, "documents"), out, vocabulary("word_bpe_49k.json"), "word", 2)
    return token_store.read_store(spark, out)


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(read_table(spark, sf_dir, "embeddings"), cosine=0.95)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (read_table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return decontaminate.contained_items(docs, items, words=5, percent=80)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read_table(spark, sf_dir, "documents"), 8)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), 1, 2048)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    return toxicity.score(docs, labels, threshold=0.5)


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(read_table(spark, sf_dir, "documents"), words=3, percent=85)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    return quality.score(docs, labels, threshold=0.7)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read_table(spark, sf_dir, "pages")).drop("distrust_share")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(read_table(spark, sf_dir, "documents"), min_docs=3, scale=1_000_000_000, top=200)


def op12_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    encoded = bpe_codec.encode(read_table(spark, sf_dir, "documents"), path).withColumn("ids_sha256", F.sha2("ids", 256))
    return bpe_codec.decode(encoded, path).withColumn("decoded", F.sha2("decoded", 256)).withColumnRenamed("decoded", "decoded_sha256")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = read_table(spark, sf_dir, "embeddings").withColumn("label", changed)
    return hard_negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0, positives=5, negatives=10, band=(30, 90))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_token_store": op2_token_store,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_decontaminate": op4_decontaminate,
    "op5_sharding": op5_sharding,
    "op6_packing": op6_packing,
    "op7_toxicity": op7_toxicity,
    "op8_near_dup": op8_near_dup,
    "op9_quality": op9_quality,
    "op10_url_filter": op10_url_filter,
    "op11_divergence": op11_divergence,
    "op12_bpe_codec": op12_bpe_codec,
    "op13_hard_negatives": op13_hard_negatives,
}

_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _shingles(table: str, key: str, size: int) -> str:
    """DuckDB query of a table's distinct (id, shingle) rows."""
    runs = f"list_transform(range(1, len(w) - {size - 2}), lambda i: array_to_string(w[i:i + {size - 1}], ' '))"
    return f"""SELECT DISTINCT id, unnest(CASE WHEN len(w) >= {size} THEN {runs} WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
    FROM (SELECT {key} AS id, regexp_extract_all(coalesce({_LOW}, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM {table})"""


_REACH = """reach AS (SELECT id, id AS root FROM nodes UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.id),
part AS (SELECT id, min(root) AS component_id FROM reach GROUP BY 1)"""


def _url_sql(damping: float = 0.85, tolerance: float = 0.01) -> str:
    """The same walk with one common table expression a round, without an early end."""
    rounds = url_filter.rounds_for(damping, tolerance)
    upper, lower = url_filter.UPPER, url_filter.LOWER
    fits = []
    for rule in sorted(url_filter.RULES, key=lambda r: (-len(r.text), r.verdict != "block", r.text)):
        test = f"(host = '{rule.host}' OR ends_with(host, '.{rule.host}')) AND starts_with(path, '{rule.path}')"
        fits.append((test, rule))
    case = lambda of: "CASE " + " ".join(f"WHEN {t} THEN '{of(r)}'" for t, r in fits) + " END"
    href = url_filter.LINK.replace("'", "''")
    target = "CASE WHEN starts_with(link, '//') THEN 'x:' || link ELSE link END"
    host = lambda c: f"translate(regexp_extract({c}, '(?s)^.*?://([^/?#]*)', 1), '{upper}', '{lower}')"
    steps = ["r0 AS (SELECT host, t0 AS t, d0 AS d FROM seeds)"]
    for k in range(1, rounds + 1):
        steps.append(f"""s{k} AS (SELECT dst AS host, sum(CASE WHEN forward THEN p * t END) AS t, sum(CASE WHEN NOT forward THEN p * d END) AS d
        FROM flow JOIN r{k - 1} ON src = host GROUP BY dst),
        r{k} AS (SELECT host, t0 * {1 - damping} + coalesce(t, 0) * {damping} AS t, d0 * {1 - damping} + coalesce(d, 0) * {damping} AS d
        FROM seeds LEFT JOIN s{k} USING (host))""")
    return f"""WITH parts AS (SELECT page_id, coalesce({host("url")}, '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, html FROM pages),
    ruled AS (SELECT *, {case(lambda r: r.text)} AS rule, {case(lambda r: r.verdict)} AS ruling FROM parts),
    hosts AS (SELECT host, count(*) FILTER (WHERE ruling = 'allow') AS a, count(*) FILTER (WHERE ruling = 'block') AS b FROM ruled WHERE host <> '' GROUP BY 1),
    links AS (SELECT host AS src, {host(target)} AS dst FROM (SELECT host, unnest(regexp_extract_all(coalesce(html, ''), '{href}', 1)) AS link FROM parts)),
    labels AS (SELECT string_split(host, '.') AS l FROM (SELECT host FROM hosts UNION SELECT dst FROM links WHERE src <> '' AND dst <> '' AND src <> dst)),
    up AS (SELECT DISTINCT src, dst FROM (SELECT array_to_string(l[k:], '.') AS src, array_to_string(l[k + 1:], '.') AS dst
    FROM (SELECT l, unnest(range(1, len(l) - 1)) AS k FROM labels WHERE len(l) > 2)) WHERE src <> dst AND src <> '' AND dst <> ''),
    edges AS (SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, count(*)::DOUBLE AS w FROM links WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY 1, 2
    UNION ALL SELECT src, dst, 1.0 FROM up UNION ALL SELECT dst, src, 1.0 FROM up) GROUP BY 1, 2),
    every AS (SELECT host, sum(a) AS a, sum(b) AS b FROM (SELECT * FROM hosts UNION ALL SELECT src, 0, 0 FROM edges UNION ALL SELECT dst, 0, 0 FROM edges) GROUP BY 1),
    seeds AS (SELECT host, coalesce(a / nullif(sum(a) OVER (), 0), 0) AS t0, coalesce(b / nullif(sum(b) OVER (), 0), 0) AS d0 FROM every),
    directed AS (SELECT src, dst, w, true AS forward FROM edges UNION ALL SELECT dst, src, w, false FROM edges),
    flow AS (SELECT src, dst, forward, w / sum(w) OVER (PARTITION BY src, forward) AS p FROM directed),
    {", ".join(steps)}
    SELECT page_id, host, path, rule, coalesce(ruling, CASE WHEN round(d / nullif(t + d, 0), 9) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
    FROM ruled LEFT JOIN r{rounds} USING (host)"""


ORACLE_SQL: dict[str, str] = {
    "op3_embedding_dedup": f"""WITH RECURSIVE v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    nodes AS (SELECT id FROM v),
    links AS (SELECT x.id AS a, y.id AS b FROM v x JOIN v y ON x.id <> y.id AND list_cosine_similarity(x.e, y.e) >= 0.95),
    {_REACH},
    n AS (SELECT a AS id, count(*) AS n FROM links GROUP BY 1)
    SELECT id AS vec_id, coalesce(n, 0) AS n_links, component_id, id = component_id AS kept FROM part LEFT JOIN n USING (id)""",
    "op4_decontaminate": f"""WITH d AS ({_shingles("documents", "doc_id", 5)}), i AS ({_shingles("benchmark", "item_id", 5)}),
    n AS (SELECT id, count(*) AS n FROM i GROUP BY 1)
    SELECT d.id AS doc_id, i.id AS item_id, any_value(n.n) AS item_shingles, count(*) AS shared
    FROM d JOIN i USING (s) JOIN n ON n.id = i.id GROUP BY d.id, i.id HAVING 100 * count(*) >= 80 * any_value(n.n)""",
    "op8_near_dup": f"""WITH RECURSIVE s AS MATERIALIZED ({_shingles("documents", "doc_id", 3)}), nodes AS (SELECT doc_id AS id FROM documents),
    n AS (SELECT id, count(*) AS n FROM s GROUP BY 1),
    pairs AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.id < y.id GROUP BY 1, 2),
    near AS (SELECT a, b FROM pairs JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
    links AS MATERIALIZED (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
    {_REACH}
    SELECT id AS doc_id, coalesce(n, 0) AS n_shingles, component_id, id = component_id AS kept FROM part LEFT JOIN n USING (id)""",
    "op10_url_filter": _url_sql(),
    "op11_divergence": f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(coalesce({_LOW}, ''), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
    t AS MATERIALIZED (SELECT r, lang, source, unnest(w) AS term FROM d),
    vocabulary AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM t GROUP BY 1, 2 HAVING count(DISTINCT r) >= 3),
    g AS (SELECT DISTINCT lang, source FROM d),
    c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
    x AS (SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n, v.n AS every FROM g JOIN vocabulary v USING (lang)
    LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
    y AS (SELECT *, sum(n) OVER w AS total, sum(every) OVER w AS of_lang, count(*) OVER w AS terms FROM x WINDOW w AS (PARTITION BY lang, source)),
    z AS MATERIALIZED (SELECT lang, source, term, n, CAST(1 + (1000000000::HUGEINT * (n + 1)) // (total + terms) AS BIGINT) AS p,
    CAST(1 + (1000000000::HUGEINT * (every + 1)) // (of_lang + terms) AS BIGINT) AS q FROM y),
    f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS v
    FROM z a JOIN z b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    rows AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(v, 0) AS BIGINT) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
    UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM z WHERE n > 0 AND p > q)
    SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM rows
    QUALIFY part = 'pair' OR rank <= 200""",
    "op13_hard_negatives": """WITH v AS (SELECT row_number() OVER () AS r, vec_id AS id,
    CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.id AS anchor_id, a.r AS a, c.id, a.label = c.label AS same, CAST(list_dot_product(a.q, c.q) AS BIGINT) AS score
    FROM v a JOIN v c ON a.r <> c.r WHERE a.id % 100 = 0),
    p AS (SELECT anchor_id, a, id AS positive_id, score AS positive_score, row_number() OVER w AS k FROM s WHERE same
    WINDOW w AS (PARTITION BY a ORDER BY score DESC, id) QUALIFY k <= 5)
    SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s ON s.a = p.a AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
    WINDOW w AS (PARTITION BY p.a, k ORDER BY score DESC, id) QUALIFY rank <= 10""",
}
