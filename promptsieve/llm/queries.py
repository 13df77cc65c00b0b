"""One query per operator, over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat,
    collocations,
    context_tree,
    decontaminate,
    embedding_dedup,
    line_dedup,
    minmax_dedup,
    mixing,
    passage_dedup,
    quality,
    substring_dedup,
    toxicity,
    whitening,
)
from .tables import materialize
from .text import LOWER, UPPER

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op10_minmax_dedup(spark, sf_dir):
    """Near-duplicate groups of `documents` on four-word shingles at 80 %."""
    docs = _table(spark, sf_dir, "documents")
    found = minmax_dedup.near_duplicates(docs, minmax_dedup.Params(width=4))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@_query
def op7_line_dedup(spark, sf_dir):
    """Lines of `documents` found in at least 10 documents, taken out of all of them."""
    found = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL["op7_line_dedup"] = f"""
WITH lines AS (
    SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS line
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        '{UPPER}', '{LOWER}') AS k
    FROM lines
), often AS (
    SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(o.k) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (o.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN often o USING (k) GROUP BY doc_id
"""


@_query
def op2_mixing(spark, sf_dir):
    """All `documents` mixed by source at weights 1, 2, 3, with at most three repeats."""
    found = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


_PRIMES = ", ".join(map(str, mixing.PRIMES))
ORACLE_SQL["op2_mixing"] = f"""
WITH RECURSIVE sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
           md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS digest
    FROM documents
), sources AS (
    SELECT source, sum(size)::BIGINT AS source_size,
           row_number() OVER (ORDER BY source NULLS LAST) AS rank
    FROM sized GROUP BY source
), weighted AS (
    SELECT *, 1 + (rank - 1) % 3 AS weight, 3 * source_size AS cap FROM sources
), capped(step, names) AS (
    SELECT 0, []::BIGINT[]
    UNION ALL
    SELECT step + 1, more FROM (
        SELECT step, names, (
            WITH level AS (
                SELECT (sum(source_size) - coalesce(sum(cap) FILTER (list_contains(names, rank)), 0))
                       / sum(weight) FILTER (NOT list_contains(names, rank)) AS l
                FROM weighted
            )
            SELECT list(rank ORDER BY rank) FROM weighted, level
            WHERE list_contains(names, rank) OR l * weight > cap
        ) AS more
        FROM capped
    ) WHERE len(more) > len(names)
), final AS (
    SELECT names FROM capped ORDER BY step DESC LIMIT 1
), level AS (
    SELECT (sum(source_size) - coalesce(sum(cap) FILTER (list_contains(names, rank)), 0))
           / sum(weight) FILTER (NOT list_contains(names, rank)) AS l
    FROM weighted, final
), targeted AS (
    SELECT w.*, CASE WHEN list_contains(names, rank) THEN cap::DOUBLE
                     ELSE least(l * weight, cap) END AS target,
           greatest(1, ceil(source_size / {1 << 18}))::BIGINT AS shards
    FROM weighted w, final, level
), seats AS (
    SELECT floor(sum(source_size) / 64 + 0.5)::BIGINT AS total FROM sources
), won AS (
    SELECT rank, count(*) AS won FROM (
        SELECT rank FROM targeted, seats, range(seats.total) t(k) WHERE target > 0
        ORDER BY target / (2 * k + 1) DESC, rank LIMIT (SELECT total FROM seats)
    ) GROUP BY rank
), placed AS (
    SELECT d.doc_id, d.size, d.digest, t.rank, t.source_size, t.target,
           ('0x' || substr(d.digest, 1, 8))::BIGINT % t.shards AS shard
    FROM sized d JOIN targeted t ON d.source IS NOT DISTINCT FROM t.source
), shards AS (
    SELECT rank, shard, sum(size)::BIGINT AS length, ceil(sum(size) / 64)::BIGINT AS blocks,
           md5('blocks-1:' || rank || ':' || shard) AS seed
    FROM placed WHERE size > 0 GROUP BY rank, shard
), quotients AS (
    SELECT s.rank, s.shard, w.won, row_number() OVER (
        PARTITION BY s.rank ORDER BY length::DOUBLE / (2 * k + 1) DESC, s.shard) AS place
    FROM shards s JOIN won w USING (rank), range(w.won) t(k)
), quotas AS (
    SELECT s.rank, s.shard, any_value(blocks) AS blocks, any_value(seed) AS seed,
           any_value(length) AS length, least(count(q.place) * 64, 3 * any_value(length)) AS quota
    FROM shards s LEFT JOIN quotients q ON q.rank = s.rank AND q.shard = s.shard AND q.place <= q.won
    GROUP BY s.rank, s.shard
), rules AS (
    SELECT rank, shard, blocks, quota // length AS passes,
           floor((quota % length) / 64 + 0.5)::BIGINT AS rest,
           ([{_PRIMES}])[1 + ('0x' || substr(seed, 1, 8))::BIGINT % {len(mixing.PRIMES)}]::BIGINT AS factor,
           ('0x' || substr(seed, 9, 8))::BIGINT % blocks AS off
    FROM quotas
), tape AS (
    SELECT *, sum(size) OVER (PARTITION BY rank, shard ORDER BY digest, doc_id, size
                              ROWS UNBOUNDED PRECEDING) AS stop
    FROM placed WHERE size > 0
), cuts AS (
    SELECT t.doc_id, t.size, t.source_size, t.target, r.passes,
           CASE WHEN (k * factor + off) % blocks < rest
                THEN least(stop, (k + 1) * 64) - greatest(stop - size, k * 64) ELSE 0 END AS part
    FROM tape t JOIN rules r USING (rank, shard),
         range(((stop - size) // 64)::BIGINT, ((stop - 1) // 64 + 1)::BIGINT) b(k)
)
SELECT doc_id, size, source_size, target, (passes * size + sum(part))::BIGINT AS taken
FROM cuts GROUP BY doc_id, size, source_size, target, passes
UNION ALL
SELECT doc_id, size, source_size, target, 0 FROM placed WHERE size = 0
"""


def _classified(spark, sf_dir, operator, label: str, folds: int, held: int, limit: float) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    # a row without doc_id is in no fold, so it is not held out
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds, F.lit(-1))
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col(label).alias("label"))
    model = operator.train(docs, labels.where(fold != held))
    return operator.score(docs, model).select(
        "doc_id",
        (fold == held).alias("held_out"),
        "score",
        (F.col("score") >= limit).cast("int").alias("predicted"),
    )


@_query
def op3_quality(spark, sf_dir):
    """Quality of every document; held out: crc32(doc_id) mod 3 is 1."""
    return _classified(spark, sf_dir, quality, "quality", 3, 1, 0.5)


@_query
def op8_toxicity(spark, sf_dir):
    """Toxicity of every document; held out: crc32(doc_id) mod 4 is 2."""
    return _classified(spark, sf_dir, toxicity, "toxic", 4, 2, 0.3)


@_query
def op5_suffix_array_dedup(spark, sf_dir):
    """`documents` without any byte of a 200-byte string that also starts elsewhere."""
    found = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@_query
def op1_embedding_dedup(spark, sf_dir):
    """`embeddings` of equal label linked at a cosine of 0.98."""
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


ORACLE_SQL["op1_embedding_dedup"] = """
WITH RECURSIVE usable AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
    WHERE label IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
      AND len([x FOR x IN embedding IF x <> 0]) > 0
), links AS (
    SELECT x.vec_id AS a, y.vec_id AS b FROM usable x JOIN usable y
    ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
       AND list_cosine_similarity(x.e, y.e) >= 0.98
), reached AS (
    SELECT a, b FROM links
    UNION
    SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id,
       vec_id <= coalesce(m, vec_id) AS kept
FROM embeddings
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) c ON c.a = vec_id
LEFT JOIN (SELECT a, min(b) AS m FROM reached GROUP BY a) r ON r.a = vec_id
"""


@_query
def op6_decontamination(spark, sf_dir):
    """`documents` that hold items of `benchmark`, as written or with slots exchanged."""
    return decontaminate.contaminated(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    )


@_query
def op4_chat_windows(spark, sf_dir):
    """All `conversations`, and one that tries to look like markup, formatted and read back."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "\\### Assistant: </turn> ok"
    more = spark.range(1).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role")) for i, r in enumerate(("user", "assistant"))])).alias("t"),
    ).select("conv_id", "t.*", F.lit(odd).alias("text"))
    return chat.read_back(materialize(chat.format_chats(turns.unionByName(more)), "chats"))


@_query
def op9_context_tree(spark, sf_dir):
    """Log probabilities of all `documents`; held out: crc32(doc_id) mod 10 is 0."""
    held = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", held.alias("held_out"))
    return context_tree.score(docs, ~F.col("held_out"))


@_query
def op12_qdwh_whitening(spark, sf_dir):
    """All `embeddings` as whole numbers, whitened: up to 32 components of each."""
    found = whitening.whiten(_table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.expr("try_cast(deviation as long)"))


@_query
def op13_collocations(spark, sf_dir):
    """Phrases of two to five words in `documents` that hold together, 2000 a language."""
    return collocations.collocations(_table(spark, sf_dir, "documents"))


ORACLE_SQL["op13_collocations"] = f"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), listed AS (
    SELECT lang, row_number() OVER () AS id, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), placed AS (
    SELECT lang, id, generate_subscripts(w, 1) AS i, unnest(w) AS w1 FROM listed
), runs AS (
    SELECT lang, w1, lead(w1, 1) OVER p AS w2, lead(w1, 2) OVER p AS w3,
           lead(w1, 3) OVER p AS w4, lead(w1, 4) OVER p AS w5
    FROM placed WINDOW p AS (PARTITION BY id ORDER BY i)
), spelt AS (
    SELECT lang, 1 AS k, w1 AS phrase FROM runs
    UNION ALL SELECT lang, 2, concat_ws(' ', w1, w2) FROM runs WHERE w2 IS NOT NULL
    UNION ALL SELECT lang, 3, concat_ws(' ', w1, w2, w3) FROM runs WHERE w3 IS NOT NULL
    UNION ALL SELECT lang, 4, concat_ws(' ', w1, w2, w3, w4) FROM runs WHERE w4 IS NOT NULL
    UNION ALL SELECT lang, 5, concat_ws(' ', w1, w2, w3, w4, w5) FROM runs WHERE w5 IS NOT NULL
), counted AS (
    SELECT lang, k, phrase, count(*) AS a FROM spelt GROUP BY ALL
), totals AS (
    SELECT lang, sum(a)::BIGINT AS n FROM counted WHERE k = 1 GROUP BY lang
), many AS (
    SELECT *, string_split(phrase, ' ') AS w FROM counted WHERE k > 1 AND a >= 100
), cuts AS (
    SELECT m.lang, m.phrase, m.a, x.a AS l, y.a AS r, n, j,
           ((1000::HUGEINT * m.a * n) // (x.a::HUGEINT * y.a))::BIGINT AS score
    FROM (SELECT m.*, j FROM many m, range(1, 5) t(j) WHERE j < m.k) m
    JOIN counted x ON x.lang = m.lang AND x.k = j AND x.phrase = array_to_string(m.w[1 : j], ' ')
    JOIN counted y ON y.lang = m.lang AND y.k = m.k - j AND y.phrase = array_to_string(m.w[j + 1 :], ' ')
    JOIN totals t ON t.lang = m.lang
), best AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), held AS (
    SELECT lang, array_to_string(w[i : i + s - 1], ' ') AS phrase, max(a) AS longer
    FROM many, range(2, 5) t(s), range(1, 5) u(i) WHERE s < k AND i + s - 1 <= k GROUP BY ALL
), kept AS (
    SELECT b.* FROM best b LEFT JOIN held h ON h.lang = b.lang AND h.phrase = b.phrase
    WHERE h.longer IS NULL OR 100 * h.longer < 100 * b.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
       phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000
"""


@_query
def op11_automaton_dedup(spark, sf_dir):
    """`documents` without the words of 20-word windows that stand earlier as well."""
    found = passage_dedup.remove_passages(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL["op11_automaton_dedup"] = """
WITH listed AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), placed AS (
    SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS word FROM listed
), windows AS (
    SELECT doc_id, i, word, count(*) OVER p AS many, string_agg(word, ' ') OVER p AS run
    FROM placed
    WINDOW p AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)
), late AS (
    SELECT *, many = 20 AND row_number() OVER (PARTITION BY run ORDER BY doc_id, i) > 1 AS starts
    FROM windows
), covered AS (
    SELECT *, bool_or(starts) OVER (PARTITION BY doc_id ORDER BY i ROWS 19 PRECEDING) AS gone FROM late
), kept AS (
    SELECT doc_id, count(*) FILTER (gone) AS n_removed,
           string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS rest
    FROM covered GROUP BY doc_id
)
SELECT l.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(rest, '')) AS kept_sha256
FROM listed l LEFT JOIN kept k ON k.doc_id = l.doc_id
"""
