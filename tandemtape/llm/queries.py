"""One query per operator, over its whole table with production parameters, and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandemtape.llm import collocations, covertree, linededup, mixing, multiindex, ngramjoin, ngramtrie, sharding, spelling, substrings, templates, toxicity, webtext
from tandemtape.llm.registry import ORACLES, QUERIES, query, table  # noqa: F401


@query("op1_kd_shards")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 40 shards of nearly equal bytes."""
    return sharding.kd_shards(table(spark, folder, "documents"), shards=40)


@query("op2_inverted_multi_index")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest vectors of every hundredth one."""
    return multiindex.search(table(spark, folder, "embeddings"))


@query("op3_toxicity_kernel")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of all documents; the fold with remainder 0 is held out."""
    return toxicity.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op4_elias_fano_lm")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of all documents under the trie and the base model; the fold with remainder 2 of 7 is held out."""
    return ngramtrie.score(table(spark, folder, "documents"))


@query("op5_template_leaks")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a benchmark item, also with other numbers, names or units: one row per document and item."""
    return templates.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("_th")


OP6_SQL = r"""
WITH split AS (
  SELECT doc_id, i, l, translate(trim(l, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)
), often AS (
  SELECT k, max(doc_id) AS holder FROM split WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
)
SELECT s.doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE o.k IS NOT NULL AND s.doc_id < o.holder)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(s.l, chr(10) ORDER BY s.i) FILTER (WHERE o.k IS NULL OR s.doc_id >= o.holder), '')) AS kept_sha256
FROM split s LEFT JOIN often o ON s.k = o.k GROUP BY s.doc_id
"""


@query("op6_line_dedup", OP6_SQL)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of at least 40 characters held by five documents stay in the largest doc_id only."""
    kept = linededup.dedup_lines(table(spark, folder, "documents"), keep=["doc_id"])
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query("op7_ngram_jaccard")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets have a Jaccard similarity of at least 0.85."""
    return ngramjoin.similar_groups(table(spark, folder, "documents"), width=4, percent=85)


#: The oracle reshares the excess round by round, as the rule is stated, and places uses by the integral of each schedule.
OP8_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS d FROM documents
), ranked AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS r FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE r % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w, 2.0::DOUBLE * source_size AS most FROM ranked
), rounds AS (
  SELECT 0 AS n, r, w, most, false AS stopped, 0.0::DOUBLE AS given, 1.5::DOUBLE * (SELECT sum(source_size) FROM weighed) AS budget FROM weighed
  UNION ALL
  SELECT n + 1, r, w, most, stopped OR share >= most, CASE WHEN stopped OR share >= most THEN most ELSE share END, budget FROM (
    SELECT *, (budget - coalesce(sum(most) FILTER (WHERE stopped) OVER (), 0)) * w / sum(w) FILTER (WHERE NOT stopped) OVER () AS share
    FROM rounds WHERE n <= (SELECT count(*) FROM weighed)
  )
), aimed AS (
  SELECT w.source, w.source_size, w.r, o.given AS target FROM weighed w JOIN rounds o ON w.r = o.r WHERE o.n = (SELECT max(n) FROM rounds)
), placed AS (
  SELECT s.doc_id, s.size, a.source_size, a.target, a.r, coalesce(sum(s.size) OVER (PARTITION BY a.r ORDER BY s.d, s.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS head
  FROM sized s JOIN aimed a ON s.source IS NOT DISTINCT FROM a.source
)
SELECT doc_id, size, source_size, round(target, 6) AS target,
  (greatest(least(floor(target + 1e-7) - head, size), 0) + greatest(least(floor(target + 1e-7) - head - source_size, size), 0))::BIGINT AS taken
FROM placed
"""


@query("op8_curriculum_mix", OP8_SQL)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """Words that the mix takes from each document."""
    planned = mixing.plan_mix(table(spark, folder, "documents"), keep=["doc_id"])
    return planned.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


@query("op9_main_text")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Article text of every page."""
    return webtext.extract(table(spark, folder, "pages"))


@query("op10_paragraph_minhash")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs of at least 20 words, or 32 around a seam or at an anchor, that several documents hold, with their clusters."""
    return substrings.repeated_paragraphs(table(spark, folder, "documents"))


#: Counts every run of up to five words of every piece; 1000 * a * n and l * r are taken in 128 bits.
OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), split AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), placed AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split
), grams AS (
  SELECT lang, w[i:i + m - 1] AS ws, m FROM placed, (SELECT unnest(range(1, 6)) AS m) WHERE i + m - 1 <= len(w)
), f AS (
  SELECT lang, ws, m, count(*) AS f FROM grams GROUP BY lang, ws, m HAVING count(*) >= 100
), sizes AS (
  SELECT lang, sum(len(w)) AS n FROM split GROUP BY lang
), inside AS (
  SELECT lang, w[i:i + m - 1] AS ws, max(f) AS held
  FROM (SELECT lang, ws AS w, f, unnest(range(1, len(ws) + 1)) AS i FROM f WHERE m > 2), (SELECT unnest(range(2, 5)) AS m)
  WHERE i + m - 1 <= len(w) AND m < len(w) GROUP BY ALL
), kept AS (
  SELECT c.lang, c.ws, c.f AS a FROM f c LEFT JOIN inside h ON c.lang = h.lang AND c.ws = h.ws WHERE c.m > 1 AND (h.held IS NULL OR 100 * h.held < 100 * c.f)
), cuts AS (
  SELECT lang, ws, a, unnest(range(1, len(ws))) AS k FROM kept
), scored AS (
  SELECT c.lang, c.ws, c.a, c.k, x.f AS l, y.f AS r, s.n, (1000 * c.a::HUGEINT * s.n::HUGEINT) // (x.f::HUGEINT * y.f::HUGEINT) AS score
  FROM cuts c JOIN f x ON c.lang = x.lang AND x.ws = c.ws[:c.k] JOIN f y ON c.lang = y.lang AND y.ws = c.ws[c.k + 1:] JOIN sizes s ON c.lang = s.lang
), weakest AS (
  SELECT *, array_to_string(ws, ' ') AS phrase FROM scored QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM weakest QUALIFY rank <= 2000
"""


@query("op11_stripe_collocations", OP11_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """The first 2,000 phrases of two to five words of every language."""
    return collocations.collocations(table(spark, folder, "documents"))


#: The checksum is taken byte by byte from its table; near words have the same rest without one character, or are such a rest.
OP12_SQL = r"""
WITH RECURSIVE places AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::UBIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS v FROM range(256) r(i))
), runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS d, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), of_doc AS (
  SELECT run, count(*) AS n, hex(encode(d || ':' || run)) AS hx FROM runs WHERE length(run) >= 6 GROUP BY d, run
), hashed AS (
  SELECT run, n, xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length(hx), 2), lambda i: ('0x' || substr(hx, i, 2))::UBIGINT)), lambda c, b: xor(c >> 8, t[((xor(c, b) & 255) + 1)::BIGINT]))) AS h FROM of_doc, places
), slipped AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n FROM hashed
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM slipped WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), rests AS (
  SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)
), one_edit AS (
  SELECT a.word AS word, b.word AS other FROM rests a JOIN rests b ON a.rest = b.rest AND a.i = b.i WHERE a.word <> b.word
  UNION SELECT a.rest, a.word FROM rests a JOIN words b ON a.rest = b.word
  UNION SELECT a.word, a.rest FROM rests a JOIN words b ON a.rest = b.word
), best AS (
  SELECT e.word, count(*) AS n_near, arg_min(o.word, (-o.n, o.word)) AS other, max(o.n) AS most FROM one_edit e JOIN words o ON e.other = o.word GROUP BY e.word
), judged AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.most >= 5 * w.n THEN b.other END AS form, CASE WHEN b.most >= 5 * w.n THEN b.most END AS form_n FROM words w LEFT JOIN best b ON w.word = b.word
), ways AS (
  SELECT word, word AS at FROM judged UNION ALL SELECT y.word, j.form FROM ways y JOIN judged j ON y.at = j.word WHERE j.form IS NOT NULL
), roots AS (
  SELECT y.word, y.at AS root FROM ways y JOIN judged j ON y.at = j.word WHERE j.form IS NULL
)
SELECT j.word, j.form, r.root, j.n::BIGINT AS n, j.n_near::BIGINT AS n_near, j.form_n::BIGINT AS form_n FROM judged j JOIN roots r ON j.word = r.word
"""


@query("op12_chunk_spellings", OP12_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Every frequent word with its commoner spelling and the root of its spellings."""
    return spelling.variants(table(spark, folder, "documents"))


#: Whole numbers below 2^53 are exact in double precision.
OP13_SQL = r"""
WITH rows AS (
  SELECT row_number() OVER () AS u, vec_id, list_transform(embedding, lambda v: floor(1024 * v::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
)
SELECT q.vec_id AS query_id, row_number() OVER (PARTITION BY q.u ORDER BY list_inner_product(q.x, c.x) DESC, c.vec_id)::INT AS rank, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
FROM rows q JOIN rows c ON q.u <> c.u WHERE q.vec_id % 100 = 0
QUALIFY rank <= 10
"""


@query("op13_dual_cover_trees", OP13_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """The ten largest inner products of every hundredth vector."""
    return covertree.search(table(spark, folder, "embeddings")).drop("query_hash")
